"""Scoring expressions: linear predictor, sigmoid, softmax, first arg-max."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_LIMIT = 500.0


def clip(x: Column, lo, hi) -> Column:
    """NULL-preserving clip (``least``/``greatest`` alone would skip NULL)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi_c), lo_c))


def dot(features: Sequence[Column], weights: Sequence[Column], bias: Column) -> Column:
    out = bias
    for x, w in zip(features, weights, strict=True):
        out = out + x * w
    return out


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(z, -Z_LIMIT, Z_LIMIT)))


def first_argmax(values: Sequence[Column], best: Column) -> Column:
    out = F.when(values[0] == best, F.lit(0))
    for k, v in enumerate(values[1:], start=1):
        out = out.when(v == best, F.lit(k))
    return out
