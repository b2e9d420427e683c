"""Keyed randomness.

Every draw is a function of (salt, seed, stream, row key, column), never of partitioning, task retry or
row order. A lost executor that recomputes its rows gets the same noise, and the same draw can be made in
any SQL engine that has md5.

The salt is the secret of a production run: who knows it can recompute the noise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_DIGITS = 13
DRAW_RANGE = float(2**52)


def row_key(*columns: str | Column) -> Column:
    """Text form of a unique row identity. Use integer, date or string columns: the text form of a
    floating point number differs between engines."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if len(cols) == 1:
        return cols[0].cast("string")
    return F.concat_ws("-", *[c.cast("string") for c in cols])


def digest(seed, stream, key: Column, col="", salt: str = "") -> Column:
    """32 hex digits; the first 26 hold two independent 52-bit draws."""
    parts: list = [salt, seed, stream, key, col]
    merged: list = []
    for part in parts:
        constant = not isinstance(part, Column)
        if constant and merged and isinstance(merged[-1], str):
            merged[-1] = f"{merged[-1]}|{part}"
        else:
            merged.append(str(part) if constant else part)
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in merged]))


def draw(hex_digest: Column, n: int = 0) -> Column:
    """The n-th uniform in [0, 1) held by a digest (n is 0 or 1)."""
    if n not in (0, 1):
        raise ValueError("a digest holds two draws: n must be 0 or 1")
    digits = F.substring(hex_digest, 1 + DRAW_DIGITS * n, DRAW_DIGITS)
    # conv is formally nullable; saying that it is not spares null handling in all that follows
    return F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(0.0)) / F.lit(DRAW_RANGE)


def uniform(seed, stream: str, key: Column, col="", n: int = 0, salt: str = "") -> Column:
    """One keyed uniform in [0, 1)."""
    return draw(digest(seed, stream, key, col, salt), n)
