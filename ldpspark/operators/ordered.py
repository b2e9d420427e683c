"""Ranks and prefix sums over a global order, without a single-partition window.

The rows are range-partitioned on the order, so a slice holds neighbouring rows and slices are of similar
size whatever the distribution. The sliced rows are written once (reliable checkpoint): slice numbers must
not change between the two passes, also when an executor is lost. Slice totals (one row per slice and key)
give the offset of each slice; the window runs inside a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return settle(ranged.withColumn("__slice", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add, for each ``value -> name``, the running total *before* the row and the group total.

    Adds ``<name>_before`` and ``<name>_all``. The order must be unique within a key: collapse ties first.
    """
    keys = list(keys)
    sliced = slices(df, keys, order)
    totals = sliced.groupBy(*keys, "__slice").agg(*[F.sum(v).alias(f"__t_{n}") for v, n in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "__slice",
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums.values()],
        *[F.sum(f"__t_{n}").over(whole).alias(f"{n}_all") for n in sums.values()],
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__l_{n}") for v, n in sums.items()]
    )
    added = [(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(f"{n}_before") for n in sums.values()]
    return local.join(offsets, [*keys, "__slice"]).select(
        *df.columns, *added, *[f"{n}_all" for n in sums.values()]
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of each row in the global order."""
    sized = df.withColumn("__one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(sized, [], order, {"__one": "__n"})
    return ranked.select(*df.columns, F.col("__n_before").alias(name))
