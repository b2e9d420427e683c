"""A keyed permutation of the places 0 .. n-1, by arithmetic alone.

The places fill a grid of about sqrt(n) columns row by row; the last row may be short. A round turns every row by an
amount that depends on the row, the next one every column by an amount that depends on the column. Each turn stays inside
its row or column, however short, so the rounds map 0 .. n-1 onto itself for any n: no place has to be walked back into the
range, and the number of operations is fixed. As in any such network, a round is undone by turning back.

The amounts come from a polynomial modulo a prime with two keyed constants per round. Products stay below 2^60, so
Spark, numpy and any SQL engine compute the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
# the Mersenne prime 2^31 - 1; tables of up to its square may be permuted
PRIME = 2**31 - 1


def constants(seed, turn, salt: str = "") -> list[int]:
    """Two numbers below 2^28 for each round of one permutation: (factor, shift), (factor, shift), ..."""
    found = []
    for n in range(ROUNDS):
        digits = hashlib.md5(f"{salt}|{seed}|permute{turn}|{n}|".encode()).hexdigest()
        found += [int(digits[:7], 16), int(digits[7:14], 16)]
    return found


def places(rank: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """The place of each rank in one permutation of 0 .. n-1."""
    x = np.asarray(rank, dtype=np.int64)
    wide = int(np.ceil(np.sqrt(float(n)))) or 1
    high = -(-n // wide)
    last = n - (high - 1) * wide
    row, col = x // wide, x % wide
    for k in range(ROUNDS):
        by = col if k % 2 else row
        t = (by * keys[2 * k] + keys[2 * k + 1]) % PRIME
        amount = (t * t % PRIME * keys[2 * k] + t) % PRIME
        if k % 2:
            row = (row + amount) % np.where(col < last, high, max(high - 1, 1))
        else:
            col = (col + amount) % np.where(row < high - 1, wide, last)
    return row * wide + col


def permute(rank: Column, n: Column, turn: Column, keys: Sequence[Sequence[int]]) -> Column:
    """The place of ``rank`` in permutation number ``turn`` of 0 .. n-1; ``keys`` lists the constants of each turn.

    Rank, size and turn are integers; a NULL in any of them gives NULL. The rounds are folded by one expression: written as
    columns that build on each other, a filter on the place would be pushed through all of them and grow sixfold a round.
    """

    def rounds(row: Sequence[int]) -> Column:
        return F.array(
            *[
                F.struct(F.lit(row[2 * k]).cast("bigint").alias("m"), F.lit(row[2 * k + 1]).cast("bigint").alias("c"), F.lit(k % 2 == 1).alias("odd"))
                for k in range(ROUNDS)
            ]
        )

    n, x = n.cast("bigint"), rank.cast("bigint")
    wide = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    high = whole(n + wide - 1, wide)
    last = n - (high - 1) * wide

    def turned(state: Column, key: Column) -> Column:
        by, moved = state["by"], state["moved"]
        t = (by * key["m"] + key["c"]) % PRIME
        amount = (t * t % PRIME * key["m"] + t) % PRIME
        inside_row = F.when(by < state["high"] - 1, state["wide"]).otherwise(state["last"])
        inside_col = F.when(by < state["last"], state["high"]).otherwise(state["high"] - 1)
        length = F.when(key["odd"], inside_col).otherwise(inside_row)
        # rows and columns take turns
        return F.struct(((moved + amount) % length).alias("by"), by.alias("moved"), *[state[c].alias(c) for c in ("wide", "high", "last")])

    start = F.struct(whole(x, wide).alias("by"), (x % wide).alias("moved"), wide.alias("wide"), high.alias("high"), last.alias("last"))
    # after an even number of rounds the row is where it began
    return F.aggregate(
        F.get(F.array(*[rounds(row) for row in keys]), turn), start, turned, lambda s: s["by"] * s["wide"] + s["moved"]
    )


def whole(a: Column, b: Column | int) -> Column:
    """Whole quotient of non-negative integers, in integer arithmetic."""
    b = b if isinstance(b, Column) else F.lit(b).cast("bigint")
    return F.call_function("div", a, b)
