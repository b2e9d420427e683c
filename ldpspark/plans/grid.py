"""Grids of runs as tables: what is asked for, joined with the settings of each dataset.

A request is (dataset, eps, label_eps); the settings have a row per dataset. The runs come out in the columns of the run
store, so a grid can be held against a store by joins, for instance to find the runs that are still to be made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runstore import RUN_COLUMNS, RUN_TYPES, run_id_column
from .config import LABEL_N, LOG_LABEL_DATASETS, N_VALUES, REGRESSION_DATASETS, SEEDS, T_VALUES, Dataset, Run

SETTINGS_SCHEMA = "dataset string, label_n int, regression boolean, log_label boolean"


def usual_settings(spark: SparkSession) -> DataFrame:
    """The fixed settings of the usual experiments as a table."""
    names = sorted({*LABEL_N, *REGRESSION_DATASETS, *LOG_LABEL_DATASETS})
    rows = [(d, LABEL_N.get(d), d in REGRESSION_DATASETS, d in LOG_LABEL_DATASETS) for d in names]
    return spark.createDataFrame(rows, SETTINGS_SCHEMA)


def _asked(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """Distinct requests with their settings. ``label_eps`` is ``eps`` where it is NULL or absent."""
    label_eps = F.coalesce(F.col("label_eps"), F.col("eps")) if "label_eps" in requests.columns else F.col("eps")
    asked = requests.where(F.col("dataset").isNotNull() & F.col("eps").isNotNull()).select(
        "dataset", F.col("eps").cast("double").alias("eps"), label_eps.cast("double").alias("label_eps")
    )
    one = settings.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in ("label_n", "regression", "log_label")]
    )
    twice = F.raise_error(F.concat(F.lit("several settings of dataset "), F.col("dataset"))).cast("int")
    one = one.withColumn("label_n", F.when(F.col("__n") > 1, twice).otherwise(F.col("label_n"))).drop("__n")
    known = asked.distinct().join(one, "dataset", "left")
    return known.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("regression", "log_label")})


def _one_of(values: Sequence, kind: str) -> Column:
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in dict.fromkeys(values)]))


def _runs(rows: DataFrame) -> DataFrame:
    columns = [F.col(c).cast(RUN_TYPES[c]).alias(c) for c in RUN_COLUMNS]
    return rows.select(*columns, "log_label").withColumn("run_id", run_id_column())


def _modes(otherwise: str) -> Column:
    both = F.array(F.lit("index"), F.lit("linear"))
    return F.explode(F.when(F.col("regression"), both).otherwise(F.array(F.lit(otherwise))))


def pm_runs(requests: DataFrame, settings: DataFrame, t: Sequence[float] = T_VALUES, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Runs of the piecewise mechanism: run columns, ``log_label``, ``run_id``.

    Regression datasets get both label modes, others a categorical label. A dataset without settings is no regression
    and has no log label; several settings of one dataset are an error. Requests without dataset or eps ask for nothing.
    """
    null = F.lit(None)
    rows = _asked(requests, settings).drop("label_n").withColumns({"mechanism": F.lit("pm"), "mode": _modes("categorical")})
    rows = rows.withColumn("t", _one_of(t, "double")).withColumn("seed", _one_of(seeds, "int"))
    return _runs(rows.withColumns({"n_outputs": null, "obj": null, "label_n": null}))


def qm_runs(
    requests: DataFrame,
    settings: DataFrame,
    n_values: Sequence[int] = N_VALUES,
    seeds: Sequence[int] = SEEDS,
    objectives: Sequence[str] = ("avg",),
) -> DataFrame:
    """Runs of the quantised mechanism, as ``pm_runs``. Labels are linear unless the dataset is a regression; they have the
    resolution of the settings, or that of the features where the settings have none."""
    rows = _asked(requests, settings).withColumns({"mechanism": F.lit("qm"), "mode": _modes("linear")})
    rows = rows.withColumn("n_outputs", _one_of(n_values, "int")).withColumn("seed", _one_of(seeds, "int"))
    rows = rows.withColumn("obj", _one_of(objectives, "string"))
    return _runs(rows.withColumns({"label_n": F.coalesce("label_n", "n_outputs"), "t": F.lit(None)}))


def missing_runs(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """Runs of a grid that a store (its ``runstore.manifest``) does not hold."""
    return runs.join(stored.select("run_id"), "run_id", "left_anti").select(*runs.columns)


def runs_of(runs: DataFrame, dataset: Dataset) -> tuple[Dataset, list[Run]]:
    """The runs of one dataset as the plans take them, in the order of their run columns, and the dataset with the log flag
    of its settings. A plan holds its runs on the driver, one line each; rows are not touched."""
    rows = runs.where(F.col("dataset") == dataset.name).orderBy(*RUN_COLUMNS[1:]).collect()
    logs = {r["log_label"] for r in rows}
    fields = [c for c in RUN_COLUMNS if c != "dataset"]
    made = [Run(**{c: r[c] for c in fields}) for r in rows]
    return (replace(dataset, log_label=logs.pop()) if logs else dataset), made
