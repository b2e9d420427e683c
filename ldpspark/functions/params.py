"""Driver-side parameters inside expressions.

Numbers that differ per experiment or per iteration go into one array literal. An array literal reaches the
generated code by reference, so new values neither change the generated source (no recompilation per
training step) nor need a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Up to this many constants are spelled out as an array of never-NULL literals, whose element access compiles
# to less code; a longer list is parsed from one string, which the optimizer handles faster.
SPELLED_OUT = 128

# Stands for infinity in comparisons: a literal needs no function call.
FAR = 1.7976931348623157e308


def _number(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return repr(math.copysign(FAR, x))
    return repr(float(x))


def double_array(values: Sequence[float]) -> Column:
    """Constant ``array<double>``; folded by the optimizer into a single literal."""
    texts = [_number(float(v)) for v in values]
    if len(texts) <= SPELLED_OUT and "NaN" not in texts:
        return F.expr("array(" + ",".join(f"{t}D" for t in texts) + ")")
    return F.split(F.lit(",".join(texts)), ",").cast("array<double>")


class Table:
    """A (row, column) block of constants looked up by an integer row column.

    Rows are padded to a power of two, so that an address is made of shifts and ors: integer arithmetic
    carries overflow checks, which would make up most of the generated code.
    """

    def __init__(self, values, row: Column | None = None):
        block = np.atleast_2d(np.asarray(values, dtype=float))
        self.bits = max(block.shape[1] - 1, 0).bit_length()
        if row is not None:
            block = np.pad(block, ((0, 0), (0, 2**self.bits - block.shape[1])))
        self.array = double_array(block.ravel())
        self.row = row
        self.width = block.shape[1]

    def at(self, k: int | Column) -> Column:
        """Constant k of the current row's entry."""
        if self.row is None:
            return self.array[k]
        return self.array[F.shiftleft(self.row, self.bits).bitwiseOR(k)]


    def attach(self, df: DataFrame, name: str) -> tuple[DataFrame, Callable[[int], Column]]:
        """Add the row's entry as one array column, for an expression that reads many of its constants.

        Each use of ``at`` carries its own copy of the block to the tasks; this carries one.
        """
        row = F.lit(0) if self.row is None else self.row
        entry = F.slice(self.array, F.shiftleft(row, self.bits) + 1, self.width)
        return df.withColumn(name, entry), lambda k: F.col(name)[k]


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
