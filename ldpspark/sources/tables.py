"""Sources and sinks: labelled tables, label metadata, results. Runs are in ``runstore``."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import nan_to_null, require_column
from .runstore import RUN_TYPES, newest, run_id_column, stamped


def _label_checked(df: DataFrame, label: str | None) -> DataFrame:
    if label is not None:
        require_column(df, label)
    return nan_to_null(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for an input that is smaller than one split per core.

    Hashing is CPU work. A large input already has more splits than cores and is left alone. With ``keys``
    (together unique or nearly so) rows are placed by hash, which needs no sort.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_csv(spark: SparkSession, path: str, label: str | None = None, schema: T.StructType | str | None = None):
    """CSV with a header. Give a schema for large files: inference reads the file twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _label_checked(reader.csv(path), label)


def read_parquet(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    return _label_checked(spark.read.parquet(path), label)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


METADATA_SCHEMA = (
    ", ".join(f"{c} {kind}" for c, kind in RUN_TYPES.items())
    + ", label_min double, label_max double, index_min double, index_max double"
)
BOUNDS = ("label_min", "label_max", "index_min", "index_max")


def save_label_metadata(spark: SparkSession, rows: list[dict], root: str) -> None:
    """One row per run whose numeric label was kept as LDP output. A run recorded again replaces its record."""
    names = [f.name for f in T._parse_datatype_string(METADATA_SCHEMA).fields]
    data = [tuple(r.get(n) for n in names) for r in rows]
    frame = spark.createDataFrame(data, METADATA_SCHEMA).withColumn("run_id", run_id_column())
    stamped(frame).coalesce(1).write.mode("append").parquet(root)


def load_label_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The last record of each run."""
    return newest(spark.read.parquet(root), ["run_id"])


def attach_label_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on the run; runs without metadata get NULL bounds, which means no inversion.

    ``metadata`` is what ``load_label_metadata`` gives: one row per run, a few hundred at most, so the broadcast does not grow
    with the data.
    """
    given = "run_id" in df.columns
    rows = df if given else df.withColumn("run_id", run_id_column())
    side = metadata.select(F.col("run_id").alias("__run_id"), *BOUNDS)
    joined = rows.join(F.broadcast(side), F.col("run_id") == F.col("__run_id"), "left").drop("__run_id")
    return joined if given else joined.drop("run_id")


def _config_id(config) -> str:
    values = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config or {})
    return hashlib.md5(json.dumps(values, default=str, sort_keys=True).encode()).hexdigest()


def save_scores(scores: DataFrame, root: str, config=None) -> None:
    """Long scores (dataset, exp, seed, variant, metric, value) under the digest of their configuration, by dataset. Scores
    saved again replace the earlier ones."""
    tagged = stamped(scores.withColumn("config_id", F.lit(_config_id(config))))
    tagged.write.mode("append").partitionBy("dataset").parquet(root)


def load_scores(spark: SparkSession, root: str, config=None) -> DataFrame:
    """The last value of each score; of one configuration, if given."""
    found = spark.read.parquet(root)
    if config is not None:
        found = found.where(F.col("config_id") == _config_id(config))
    return newest(found, [c for c in found.columns if c not in ("value", "saved_at")]).drop("saved_at")


def save_report(report: DataFrame, path: str) -> None:
    """Small mean table as one CSV file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_config(spark: SparkSession, config, path: str) -> None:
    """Configuration dataclass as one JSON row."""
    values = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config)
    spark.createDataFrame([(json.dumps(values, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def append_summary(report: DataFrame, config: dict, root: str) -> None:
    """Append the mean table of one run with its configuration columns. ``load_summary`` reads the last table of each
    configuration, so a repeated job does not double its rows."""
    tagged = report.withColumns({name: F.lit(value) for name, value in config.items()})
    stamped(tagged.withColumn("config_id", F.lit(_config_id(config)))).coalesce(1).write.mode("append").parquet(root)


def load_summary(spark: SparkSession, root: str) -> DataFrame:
    """The last mean table of each configuration."""
    found = spark.read.option("mergeSchema", True).parquet(root)
    last = found.groupBy("config_id").agg(F.max("saved_at").alias("saved_at"))
    return found.join(last, ["config_id", "saved_at"], "left_semi").drop("config_id", "saved_at")
