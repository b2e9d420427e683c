import pytest
from pyspark.sql import functions as F

from ldpspark.plans import grid
from ldpspark.plans.config import Dataset, pm_grid, qm_grid
from ldpspark.plans.privatise import fit_dataset, prepare, privatise
from ldpspark.sources import runstore


def asked(spark, rows, schema="dataset string, eps double, label_eps double"):
    return spark.createDataFrame(rows, schema)


def test_usual_grids_come_from_the_tables(spark):
    settings = grid.usual_settings(spark)
    wanted = asked(spark, [("wine", e, None) for e in (1.0, 2.0)] + [("wine", 1.0, 1.0), ("other", 1.0, 3.0), (None, 1.0, None), ("wine", None, 1.0)])
    table = grid.qm_runs(wanted, settings, n_values=(5, 9), seeds=(0, 1)).cache()
    data, runs = grid.runs_of(table, Dataset("wine", ("k",), "y"))
    want = qm_grid("wine", (1.0, 2.0), (5, 9), (0, 1))
    assert sorted(map(repr, runs)) == sorted(map(repr, want)) and not data.log_label
    _, others = grid.runs_of(table, Dataset("other", ("k",), "y"))
    assert {(r.mode, r.label_eps, r.label_n, r.n_outputs) for r in others} == {("linear", 3.0, 5, 5), ("linear", 3.0, 9, 9)}
    assert {r["run_id"] for r in table.where("dataset = 'wine'").collect()} == {runstore.run_id("wine", r) for r in want}

    pm = grid.pm_runs(asked(spark, [("iris", 1.0), ("Beijing_housing", 2.0)], "dataset string, eps double"), settings, (2.0, 3.0), (0, 1))
    _, runs = grid.runs_of(pm, Dataset("iris", ("k",), "y"))
    assert sorted(map(repr, runs)) == sorted(map(repr, pm_grid((1.0,), (2.0, 3.0), seeds=(0, 1))))
    assert grid.runs_of(pm, Dataset("Beijing_housing", ("k",), "y"))[0].log_label
    assert grid.runs_of(pm, Dataset("absent", ("k",), "y"))[1] == []


def test_settings_are_one_row_a_dataset(spark):
    twice = spark.createDataFrame([("a", 2, False, False), ("a", 3, False, False)], grid.SETTINGS_SCHEMA)
    with pytest.raises(Exception, match="several settings of dataset a"):
        grid.qm_runs(asked(spark, [("a", 1.0, None)]), twice).collect()
    none = spark.createDataFrame([], grid.SETTINGS_SCHEMA)
    assert grid.pm_runs(asked(spark, []), none).count() == 0


def test_runs_that_a_store_lacks(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 7 * 1.5).alias("a"), (F.col("id") % 5 * 2.0).alias("y"))
    settings = spark.createDataFrame([("people", None, True, False)], grid.SETTINGS_SCHEMA)
    table = grid.pm_runs(asked(spark, [("people", 1.0, None), ("people", 2.0, None)]), settings, seeds=(0,))
    data, first = grid.runs_of(table.where("eps = 1.0"), Dataset("people", ("k",), "y", ("a",)))
    prepared = prepare(rows, data)
    runstore.save_runs(privatise(prepared, fit_dataset(prepared, data), first), str(tmp_path), data.key)
    left = grid.missing_runs(table, runstore.manifest(spark, str(tmp_path), dataset="people"))
    assert sorted(map(tuple, left.select("eps", "mode").collect())) == [(2.0, "index"), (2.0, "linear")]
