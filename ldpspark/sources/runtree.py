"""Privatised runs kept as a tree of CSV files that carry the run in their names.

``<root>/[inverse_index|inverse_linear]/<dataset>/<mechanism>/<name>_train.csv``, where the name is
``<dataset>_Eps1.0_t3_Leps1.0_seed0`` for the piecewise and ``<dataset>_Eps1.0_N7_avg_Leps1.0_LN7_seed0`` for the
quantised mechanism. A folder of part files may stand for a file.

The run columns are expressions over the path of the file. Spark applies a filter on them when it lists the input, so a
run out of a tree of many is read by opening its own files only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import nan_to_null
from .runstore import RUN_COLUMNS, RUN_TYPES, run_id_column

# Folders that tell how a numeric label was kept.
MODE_FOLDERS = {"inverse_index": "index", "inverse_linear": "linear"}
# Fixed format of a run's name, after the dataset.
NAME = r"_Eps([0-9.]+)_(?:t([0-9.]+)|N([0-9]+)_([a-z]+))_Leps([0-9.]+)(?:_LN([0-9]+))?_seed([0-9]+)_(train|test)(?:\.csv|/)"
NAME_GROUPS = {"eps": 1, "t": 2, "n_outputs": 3, "obj": 4, "label_eps": 5, "label_n": 6, "seed": 7, "split": 8}


def _pattern(dataset: str) -> str:
    return "/(?:[^/=]+=)?" + re.escape(dataset) + NAME


def _from_path(path: Column, dataset: str, plain_mode: str) -> dict[str, Column]:
    pattern = F.lit(_pattern(dataset))
    found = {
        name: F.nullif(F.regexp_extract(path, _pattern(dataset), group), F.lit("")).cast(RUN_TYPES.get(name, "string"))
        for name, group in NAME_GROUPS.items()
    }
    mode = F.lit(plain_mode)
    for folder, kept in MODE_FOLDERS.items():
        mode = F.when(path.contains(f"/{folder}/"), F.lit(kept)).otherwise(mode)
    return {
        "dataset": F.when(F.regexp_like(path, pattern), F.lit(dataset)),
        "mechanism": F.when(found["t"].isNotNull(), F.lit("pm")).otherwise(F.lit("qm")),
        "mode": mode,
        **found,
    }


def _schema(spark: SparkSession, files: Sequence[str], key: str) -> T.StructType:
    """Columns of one file; all runs of a dataset have the same. Numbers are double: a run may happen to hold whole ones."""
    one = spark.read.option("header", True).option("inferSchema", True).csv(files[0]).schema
    fields = [T.StructField(key, one.fields[0].dataType)]
    for f in one.fields[1:]:
        fields.append(T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.NumericType) else f.dataType))
    return T.StructType(fields)


def load_run_tree(
    spark: SparkSession,
    root: str,
    dataset: str,
    key: str,
    *,
    plain_mode: str = "categorical",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Rows of all runs of a dataset: run columns, ``run_id``, ``split``, the columns of the files.

    The first column of a file holds the row key and is named ``key``, whatever its header says. Runs outside the two
    label folders have the mode ``plain_mode``. Files of other datasets and files named otherwise take no part. NaN and
    empty cells are NULL. Without ``schema`` one file is read for it; a tree without a file of the dataset is an error,
    as is a column of the files that is named like a run column. ``compare(privatised=...)`` takes the rows as they are.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if schema is None:
        # names only, which the driver lists for any read; no file is opened
        files = sorted(f for f in reader.text(root).inputFiles() if re.search(_pattern(dataset), f))
        if not files:
            raise KeyError(f"no run of {dataset} under {root}")
        schema = _schema(spark, files, key)
    rows = reader.schema(schema).option("header", True).csv(root)
    clash = sorted({c.lower() for c in rows.columns} & {*RUN_COLUMNS, "run_id", "split"})
    if clash:
        raise ValueError(f"columns named like run columns: {clash}")
    run = _from_path(F.col("_metadata.file_path"), dataset, plain_mode)
    named = rows.select(*[c.alias(n) for n, c in run.items()], *[F.col(f"`{c}`") for c in rows.columns])
    columns = [*RUN_COLUMNS, "run_id", "split", *rows.columns]
    known = named.where(F.col("dataset").isNotNull()).withColumn("run_id", run_id_column())
    return nan_to_null(known.select(*[F.col(f"`{c}`") for c in columns]))
