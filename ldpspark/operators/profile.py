"""Profiling and projection: missing ratios, column kinds, usable features, label transforms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSFORM_THRESHOLD = 0.5
MODEL_THRESHOLD = 0.4


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"label column '{name}' is not in the table")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, so that every aggregate skips it."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c)
            for c in df.columns
        ]
    )


def missing_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: (column, ratio). One pass, one partial aggregate per column."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.avg(quoted(c).isNull().cast("int")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "ratio")


def missing_columns(columns: Sequence[str]) -> list[Column]:
    """The aggregates of ``missing_ratio``, for an aggregate that has others as well."""
    return [F.avg(quoted(c).isNull().cast("int")).alias(f"missing|{c}") for c in columns]


def missing_from(row: Row, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: row[f"missing|{c}"] for c in columns}


def above(missing: dict[str, float | None], threshold: float) -> set[str]:
    """Names whose share is strictly above the threshold."""
    return {c for c, share in missing.items() if share is not None and share > threshold}


def columns_above(ratios: DataFrame, threshold: float, exempt: Iterable[str] = ()) -> list[str]:
    """Names whose ratio is strictly above the threshold."""
    keep = set(exempt)
    rows = ratios.where(F.col("ratio") > F.lit(float(threshold))).collect()
    found = {r["column"] for r in rows} - keep
    return sorted(found)


def drop_sparse(df: DataFrame, threshold: float = TRANSFORM_THRESHOLD, exempt: Iterable[str] = (), columns=None):
    """Drop the columns that are missing more often than the threshold (one job, then a projection)."""
    return df.drop(*columns_above(missing_ratio(df, columns), threshold, exempt))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Everything that is not numeric; booleans count as categories."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType) and f.name not in skip]


def numeric_projection(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Drop the categorical columns except those named in ``keep`` (label, row key)."""
    wanted = set(keep) | set(numeric_columns(df))
    return df.select(*[quoted(c) for c in df.columns if c in wanted])


def usable_features(df: DataFrame, label: str, exclude: Iterable[str] = (), threshold: float = MODEL_THRESHOLD):
    """Numeric features that survive the model-stage threshold; the label is tested like any column."""
    numeric = numeric_columns(df, exclude)
    sparse = set(columns_above(missing_ratio(df, numeric), threshold))
    return [c for c in numeric if c not in sparse and c != label]


def log_label(df: DataFrame, label: str) -> DataFrame:
    """log1p of the label; NULL where it is not defined."""
    x = quoted(label).cast("double")
    return df.withColumn(label, F.when(x > -1.0, F.log1p(x)))


def exp_label(x: Column) -> Column:
    return F.expm1(x)


def before_after(before: DataFrame, after: DataFrame, key: str, label: str, n: int = 5) -> DataFrame:
    """The first n labels by key of the privatised rows, with the same rows' labels before.

    The n rows are taken first, so the join has n rows on one side and no table is shuffled.
    """
    right = after.select(key, quoted(label).alias("after")).orderBy(key).limit(n)
    left = before.select(key, quoted(label).alias("before"))
    return left.join(F.broadcast(right), key).orderBy(key)
