"""Joins on row identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_ids(raw: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Wanted ids that the raw table does not have."""
    return ids.select(key).join(raw.select(key), key, "left_anti")


def select_by_ids(raw: DataFrame, ids: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Raw rows with the given ids. An id without a row ends the job that reads the result, in the same join."""
    if not check:
        return raw.join(ids.select(key), key)
    found = ids.select(key).join(raw.withColumn("__hit", F.lit(True)), key, "left")
    message = F.concat(F.lit(f"the raw table lacks an id of '{key}': "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    return found.where(F.coalesce("__hit", F.raise_error(message).cast("boolean"))).select(
        key, *[c for c in raw.columns if c != key]
    )


def align(predictions: DataFrame, truth: DataFrame, key: str, label: str, as_name: str = "truth") -> DataFrame:
    """Attach the raw label to predictions of the same rows."""
    return predictions.join(truth.select(key, F.col(label).alias(as_name)), key)
