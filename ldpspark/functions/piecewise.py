"""Continuous piecewise mechanism (PM) on [-1, 1].

With E = exp(eps) and T = exp(eps / t): core probability E / (E + T), core interval
[K(xT - 1), K(xT + 1)] with K = (E + T) / (T (E - 1)), outputs in [-A, A] with A = K (T + 1).
The parameters may be numbers (one mechanism) or columns (a grid in the rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layers import Layered
from .params import as_column
from .rand import digest, draw


@dataclass(frozen=True)
class Piecewise:
    """Parameters of one mechanism."""

    eps: float
    t: float = 3.0
    span: float = 1.0

    @property
    def big_e(self) -> float:
        return math.exp(self.eps)

    @property
    def big_t(self) -> float:
        return math.exp(self.eps / self.t)

    @property
    def k(self) -> float:
        return (self.big_e + self.big_t) / (self.big_t * (self.big_e - 1.0))

    @property
    def a(self) -> float:
        return (self.big_e + self.big_t) * (self.big_t + 1.0) / (self.big_t * (self.big_e - 1.0))

    @property
    def p_core(self) -> float:
        return self.big_e / (self.big_e + self.big_t)

    def columns(self) -> dict[str, Column]:
        return {
            "pm_t": F.lit(self.big_t),
            "pm_k": F.lit(self.k),
            "pm_a": F.lit(self.a),
            "pm_p": F.lit(self.p_core),
        }


def parameter_columns(eps: Column, t: Column) -> dict[str, Column]:
    """The same parameters for a budget held in columns."""
    e, tt = F.exp(eps), F.exp(eps / t)
    return {
        "pm_t": tt,
        "pm_k": (e + tt) / (tt * (e - F.lit(1.0))),
        "pm_a": (e + tt) * (tt + F.lit(1.0)) / (tt * (e - F.lit(1.0))),
        "pm_p": e / (e + tt),
    }


def core_interval(v: Column, params: dict[str, Column]) -> tuple[Column, Column]:
    scaled = v * params["pm_t"]
    return params["pm_k"] * (scaled - F.lit(1.0)), params["pm_k"] * (scaled + F.lit(1.0))


def perturb(
    output: str,
    value: Column,
    params: dict[str, Column],
    key: Column,
    seed,
    col: str,
    *,
    stream: str = "pm",
    span=1.0,
    null_policy: str = "null",
    test: Column | None = None,
    salt: str = "",
) -> Layered:
    """Randomised output for a value already scaled to [-span, span].

    Rows where ``test`` holds get a draw from the core interval instead (see ``core_draw``); one hash per
    row serves both, as a row is either train or test.

    ``null_policy="null"`` keeps NULL. ``"zero_or_nan"`` gives NaN in the core branch and 0 in the tail
    branch, which is what whole-array arithmetic on missing values yields.
    """
    if null_policy not in ("null", "zero_or_nan"):
        raise ValueError(f"unknown null_policy: {null_policy}")
    width = as_column(span)

    def final(c):
        a, l, r = params["pm_a"], c("l"), c("r")
        w = c("u1") * ((l + a) + (a - r))
        tail = F.when(w < l + a, w - a).otherwise(r + (w - (l + a)))
        core = l + (r - l) * c("u1")
        noisy = F.when(c("u0") < params["pm_p"], core).otherwise(tail) * width
        if null_policy != "null":
            missing = F.when(c("u0") < params["pm_p"], F.lit(float("nan"))).otherwise(F.lit(0.0))
            noisy = F.when(c("v").isNull(), missing).otherwise(noisy)
        if test is None:
            return noisy
        return F.when(test, (l + (r - l) * c("u0")) * width).otherwise(noisy)

    def interval(c):
        l, r = core_interval(c("v"), params)
        return {"u0": draw(c("h"), 0), "u1": draw(c("h"), 1), "l": l, "r": r}

    return Layered(
        output,
        [lambda c: {"h": digest(seed, stream, key, col, salt), "v": value / width}, interval],
        final,
    )


def core_draw(
    output: str,
    value: Column,
    params: dict[str, Column],
    key: Column,
    seed,
    col: str,
    *,
    stream: str = "pm",
    span=1.0,
    mode: str = "uniform",
    salt: str = "",
) -> Layered:
    """Test-side output: a draw inside the core interval, or its middle with ``mode="midpoint"``."""
    if mode not in ("uniform", "midpoint"):
        raise ValueError(f"unknown mode: {mode}")
    width = as_column(span)

    def interval(c):
        l, r = core_interval(c("v"), params)
        if mode == "midpoint":
            return {"l": l, "r": r}
        return {"l": l, "r": r, "u0": draw(c("h"), 0)}

    def final(c):
        if mode == "midpoint":
            return (c("l") + c("r")) / F.lit(2.0) * width
        return (c("l") + (c("r") - c("l")) * c("u0")) * width

    def first(c):
        if mode == "midpoint":
            return {"v": value / width}
        return {"h": digest(seed, stream, key, col, salt), "v": value / width}

    return Layered(output, [first, interval], final)
