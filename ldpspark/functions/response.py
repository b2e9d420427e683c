"""Randomised response for categories.

``mode="all"`` redraws from all k categories, the true one included: the keep rate is p + (1 - p) / k and
the effective budget is ln(1 + k E / (k - 1)), larger than eps. ``mode="strict"`` redraws from the k - 1
others, which meets eps exactly; it is the default for new work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layers import Layered
from .params import as_column
from .rand import digest, draw

MODES = ("strict", "all")


def keep_probability(eps: float, k: int) -> float:
    e = math.exp(eps)
    return e / (e + k - 1)


def effective_epsilon(eps: float, k: int) -> float:
    """Budget that the redraw-from-all form really spends."""
    return math.log(1.0 + k * math.exp(eps) / (k - 1)) if k > 1 else 0.0


def keep_probability_column(eps: Column, k: Column) -> Column:
    return F.exp(eps) / (F.exp(eps) + k - 1)


def effective_epsilon_column(eps: Column, k: Column) -> Column:
    return F.when(k > 1, F.log(1.0 + k * F.exp(eps) / (k - 1))).otherwise(0.0)


def respond_index(
    output: str,
    index: Column,
    k,
    p,
    key: Column,
    seed,
    col: str,
    *,
    mode: str = "strict",
    stream: str = "de",
    salt: str = "",
) -> Layered:
    """Perturb an integer code in 0..k-1; NULL stays NULL. ``k`` and ``p`` may be columns."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    size = k if isinstance(k, Column) else F.lit(int(k))
    keep = as_column(p)

    def final(c):
        if mode == "all":
            other = F.floor(c("u1") * size).cast("int")
        else:
            # k = 1 has no other category: keep the code
            step = F.floor(c("u1") * (size - 1)).cast("int") + 1
            other = (c("i") + step) % size
        return F.when(c("i").isNull(), None).when(c("u0") > keep, other).otherwise(c("i")).cast("int")

    return Layered(
        output,
        [
            lambda c: {"i": index, "h": digest(seed, stream, key, col, salt)},
            lambda c: {"u0": draw(c("h"), 0), "u1": draw(c("h"), 1)},
        ],
        final,
    )
