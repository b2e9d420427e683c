"""Portions of a batch of texts that bound what a Python worker holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PORTION = 1 << 20


def portions(column: pa.Array, chars: int = PORTION) -> Iterator[list[str]]:
    """The texts in order, NULL as empty, in lists of up to ``chars`` characters (or one longer text)."""
    held: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
