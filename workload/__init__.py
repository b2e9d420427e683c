"""Queries over the given tables, one per operator, with the SQL they are checked against."""

from __future__ import annotations

from types import SimpleNamespace


def load() -> SimpleNamespace:
    """Import the query modules once and return both registries."""
    from . import mechanism_queries, model_queries, noise_queries, prepare_queries, store_queries  # noqa: F401
    from .registry import ORACLE, QUERIES

    return SimpleNamespace(queries=QUERIES, oracle=ORACLE)
