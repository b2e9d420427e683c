"""Fitted preprocessing: fit is one aggregate that returns scalars, apply is a projection.

Both scalers treat a constant column as the usual array libraries do (divide by one), which Spark ML's
scalers do not; that is why they are written out here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .profile import quoted

PRIVATE_RANGE = (-1.0, 1.0)


@dataclass(frozen=True)
class Stats:
    """Statistics of one column; None when it has no value."""

    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None

    @property
    def spread(self) -> float:
        """max - min, or 1 for a constant or empty column."""
        if self.min is None or self.max == self.min:
            return 1.0
        return self.max - self.min


STATISTICS = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}


def fit(df: DataFrame, columns: Sequence[str], stats: Sequence[str] = ("min", "max"), where: Column | None = None):
    """Statistics of all columns in one job: ``{column: Stats}``.

    ``where`` limits the rows (the train part) inside the aggregate, so other totals can share the scan.
    """
    row = df.agg(*fit_columns(columns, stats, where)).head()
    return fitted_from(row, columns, stats)


def fit_columns(columns: Sequence[str], stats: Sequence[str], where: Column | None = None) -> list[Column]:
    """The aggregates of ``fit``, for an aggregate that has others as well."""
    wanted = []
    for c in columns:
        x = quoted(c).cast("double")
        x = x if where is None else F.when(where, x)
        wanted += [STATISTICS[s](x).alias(f"{s}|{c}") for s in stats]
    return wanted


def fitted_from(row: Row, columns: Sequence[str], stats: Sequence[str]) -> dict[str, Stats]:
    return {c: Stats(**{s: row[f"{s}|{c}"] for s in stats}) for c in columns}


def standardised(x: Column, s: Stats) -> Column:
    """(x - mean) / population std; a zero std divides by one."""
    return (x - F.lit(s.mean)) / F.lit(s.std if s.std else 1.0)


def min_max(x: Column, s: Stats, lo: float, hi: float) -> Column:
    """Train range to [lo, hi]; other values may fall outside; a constant train column maps to lo."""
    if s.min is None:
        return F.lit(None).cast("double")
    return F.lit(lo) + (x - F.lit(s.min)) / F.lit(s.spread) * F.lit(hi - lo)


def standardise(df: DataFrame, fitted: dict[str, Stats]) -> DataFrame:
    return df.select(
        *[standardised(quoted(c).cast("double"), fitted[c]).alias(c) if c in fitted else quoted(c) for c in df.columns]
    )


def scale_min_max(df: DataFrame, fitted: dict[str, Stats], lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    return df.select(
        *[min_max(quoted(c).cast("double"), fitted[c], lo, hi).alias(c) if c in fitted else quoted(c) for c in df.columns]
    )


def standardise_then_min_max(df: DataFrame, fitted: dict[str, Stats], lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Both scalers in a row are one affine map with the same end points, so only the second is computed."""
    return scale_min_max(df, fitted, lo, hi)


def model_range(n_outputs: int) -> tuple[float, float]:
    half = (n_outputs - 1) / 2
    return -half, half


def scale_for_model(
    df: DataFrame, fitted: dict[str, Stats], mechanism: str, n_outputs: int, columns: Sequence[str]
) -> DataFrame:
    """Raw and PM data to the model range with NULL as 0; QM data already are small integers."""
    if mechanism not in ("raw", "pm", "qm"):
        raise ValueError(f"unknown mechanism: {mechanism}")
    if mechanism == "qm":
        return df
    lo, hi = model_range(n_outputs)
    return scale_min_max(df, {c: fitted[c] for c in columns}, lo, hi).fillna(0.0, subset=list(columns))


def impute_mean(df: DataFrame, fitted: dict[str, Stats]) -> DataFrame:
    """NULL becomes the train mean, label included; integer columns become double."""
    return df.select(
        *[
            F.coalesce(quoted(c).cast("double"), F.lit(fitted[c].mean)).alias(c) if c in fitted else quoted(c)
            for c in df.columns
        ]
    )


def linear_map(x: Column, from_lo, from_hi, to_lo, to_hi) -> Column:
    """[from_lo, from_hi] to [to_lo, to_hi]; a degenerate source range gives to_lo."""
    if isinstance(from_lo, Column) or isinstance(from_hi, Column):
        width = F.nullif(from_hi - from_lo, F.lit(0.0))
        return F.coalesce((x - from_lo) / width, F.when(x.isNotNull(), F.lit(0.0))) * (to_hi - to_lo) + to_lo
    if from_hi == from_lo:
        return F.when(x.isNotNull(), F.lit(float(to_lo)))
    return (x - F.lit(float(from_lo))) / F.lit(float(from_hi - from_lo)) * F.lit(float(to_hi - to_lo)) + F.lit(float(to_lo))
