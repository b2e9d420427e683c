"""Privatised runs on disk: rows under the digest of their run key, and a manifest of the runs that are finished.

``<root>/data/run_id=../save=../split=..`` holds the rows, ``<root>/manifest`` one row for each finished save of a run, with
the run key, the number of rows and two sums over the hashed row keys. A save writes new folders and then its manifest
rows, so readers see a run whole or not at all, and saving a run again replaces it without touching the others.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import quoted

RUN_TYPES = {
    "dataset": "string", "mechanism": "string", "mode": "string", "eps": "double", "t": "double", "n_outputs": "int",
    "obj": "string", "label_eps": "double", "label_n": "int", "seed": "int",
}
RUN_COLUMNS = tuple(RUN_TYPES)
MANIFEST_SCHEMA = (
    ", ".join(f"{c} {kind}" for c, kind in RUN_TYPES.items())
    + ", run_id string, save string, saved_at bigint, n_rows bigint, key_sum decimal(38,0), key_mix decimal(38,0), layout string"
)
# budgets are told apart to this fraction
RESOLUTION = 1e9
PLACES = ("run_id", "save", "split")
# rows of a run are dealt in parts of about so many
PART_ROWS = 500_000


# ------------------------------------------------------------------ identity


def run_id(dataset: str, run) -> str:
    """Digest of the full run key of a ``Run``."""
    values = [dataset, *(getattr(run, c) for c in RUN_COLUMNS[1:])]
    texts = []
    for name, value in zip(RUN_COLUMNS, values):
        if value is not None and RUN_TYPES[name] == "double":
            value = math.floor(value * RESOLUTION + 0.5)
        texts.append("~" if value is None else f"{name}={value}")
    return hashlib.md5("\n".join(texts).encode()).hexdigest()


def run_id_column() -> Column:
    """The same digest from the run columns of a table."""
    texts = []
    for name, kind in RUN_TYPES.items():
        value = F.col(name).cast(kind)
        if kind == "double":
            value = F.floor(value * RESOLUTION + 0.5)
        texts.append(F.coalesce(F.concat(F.lit(f"{name}="), value.cast("string")), F.lit("~")))
    return F.md5(F.concat_ws("\n", *texts))


def key_sums(keys: Sequence[str]) -> list[Column]:
    """Aggregates that tell whether two tables hold the same row keys equally often: rows, and two sums of hashes."""
    names = [quoted(k).cast("string") for k in keys]
    exact = lambda h: F.sum(h.cast("decimal(38,0)"))
    return [
        F.count(F.lit(1)).alias("n_rows"),
        exact(F.xxhash64(*names)).cast("decimal(38,0)").alias("key_sum"),
        exact(F.xxhash64(F.lit(1), *names)).cast("decimal(38,0)").alias("key_mix"),
    ]


def newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The record saved last for each key; of records saved at once, the greatest."""
    others = [c for c in df.columns if c not in keys and c != "saved_at"]
    last = F.max(F.struct("saved_at", *[quoted(c) for c in others])).alias("__last")
    return df.groupBy(*[quoted(k) for k in keys]).agg(last).select(*[quoted(k) for k in keys], "__last.*").select(*[quoted(c) for c in df.columns])


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("saved_at", F.lit(time.time_ns()))


# ------------------------------------------------------------------ rows


def save_runs(df: DataFrame, root: str, key: Sequence[str]) -> str:
    """Write privatised rows, which carry the run columns, ``split`` and their row ``key``. Returns the name of the save.

    A run that is stored already is replaced as soon as this save is finished; all other runs stay, whatever part of the
    run key they differ in. If the job dies earlier, the store is as it was.

    Rows are rebalanced by parts of runs: adaptive execution joins small ones to partitions of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``. It splits a run only between map tasks, whose share of a run grows
    with the table, and a write sorts what it gets; so a job counts the rows of the runs first, which needs no noise.
    """
    spark, save, data = df.sparkSession, uuid.uuid4().hex, f"{root}/data"
    typed = df.withColumns({c: F.col(c).cast(kind) for c, kind in RUN_TYPES.items()}).drop("run", *PLACES[:2])
    rows = typed.withColumns({"run_id": run_id_column(), "save": F.lit(save)})
    total, largest = typed.groupBy(*RUN_COLUMNS).count().agg(F.sum("count"), F.max("count")).head()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (total or 0) // PART_ROWS)
    part = F.pmod(F.xxhash64(*[quoted(k) for k in key]), F.lit(1 + (largest or 0) // PART_ROWS))
    dealt = rows.withColumn("__part", part).hint("rebalance", tasks, F.col("run_id"), F.col("split"), F.col("__part")).drop("__part")
    dealt.write.mode("append").partitionBy(*PLACES).parquet(data)
    layout = T.StructType([f for f in rows.schema.fields if f.name not in PLACES] + [T.StructField(c, T.StringType()) for c in PLACES])
    try:
        written = spark.read.schema(layout).option("basePath", data).parquet(f"{data}/run_id=*/save={save}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        # no rows, no runs
        return save
    done = written.groupBy(*RUN_COLUMNS, "run_id", "save").agg(*key_sums(key)).withColumn("layout", F.lit(layout.json()))
    columns = [f.name for f in T._parse_datatype_string(MANIFEST_SCHEMA).fields]
    stamped(done).select(*columns).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return save


def every_save(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def manifest(spark: SparkSession, root: str, **run_key) -> DataFrame:
    """The finished runs that match the given run columns or ``run_id``, one row each."""
    unknown = set(run_key) - {*RUN_COLUMNS, "run_id"}
    if unknown:
        raise ValueError(f"unknown run key columns: {sorted(unknown)}")
    found = newest(every_save(spark, root), ["run_id"])
    for name, value in run_key.items():
        found = found.where(F.col(name).eqNullSafe(F.lit(value)))
    return found


def read_runs(spark: SparkSession, root: str, listed: Iterable[Row], split: str | None = None) -> DataFrame:
    """Rows of the listed manifest rows; only their folders are opened, and no schema is inferred."""
    layouts: dict[str, list[str]] = {}
    for r in listed:
        layouts.setdefault(r["layout"], []).append(f"{root}/data/run_id={r['run_id']}/save={r['save']}")
    parts = [
        spark.read.schema(T.StructType.fromJson(json.loads(layout))).option("basePath", f"{root}/data").parquet(*paths)
        for layout, paths in layouts.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return (out if split is None else out.where(F.col("split") == split)).drop("save")


def load_runs(spark: SparkSession, root: str, split: str | None = None, **run_key) -> DataFrame:
    """Rows of the matching runs, with their run columns and ``run_id``. The manifest, a row for each run, names the folders."""
    listed = manifest(spark, root, **run_key).collect()
    if listed:
        return read_runs(spark, root, listed, split)
    others = every_save(spark, root).head(1)
    if not others:
        raise ValueError(f"no runs are stored under {root}")
    return read_runs(spark, root, others, split).limit(0)


def forget_replaced(spark: SparkSession, root: str) -> int:
    """Delete the folders of replaced and unfinished saves; no save may be under way. Returns how many were deleted."""
    kept = {(r["run_id"], r["save"]) for r in manifest(spark, root).select("run_id", "save").collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/run_id=*/save=*")) or []:
        place = found.getPath()
        name = (place.getParent().getName().removeprefix("run_id="), place.getName().removeprefix("save="))
        if name not in kept and files.delete(place, True):
            gone += 1
    return gone


def differing_keys(raw: DataFrame, listed: Iterable[Row], keys: Sequence[str]) -> list[Row]:
    """Manifest rows of runs that do not hold the row keys of ``raw``, each as often.

    One aggregate over the raw keys against the sums in the manifest: no stored row is read, none is shuffled.
    """
    want = raw.agg(*key_sums(keys)).first()
    return [r for r in listed if any(r[c] != want[c] for c in ("n_rows", "key_sum", "key_mix"))]
