"""What one task holds does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from ldpspark.operators import mechanism as mech
from ldpspark.session import scratch_path
from ldpspark.sources import catalog, runstore
from workload import load


def many_budgets(spark, n, n_outputs):
    return spark.range(n).select((F.col("id") / 10_000.0 + 0.5).alias("eps"), (n_outputs - F.col("id") % 2).cast("int").alias("n_outputs"))


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


@pytest.mark.parametrize("make", [mech.candidates, mech.sweep, mech.design, mech.start_table])
def test_budgets_are_dealt_by_their_cells(spark, make):
    budgets = many_budgets(spark, 6_000, 13)
    tasks = make(budgets).select(F.spark_partition_id().alias("task"), "eps").groupBy("task").agg(F.count_distinct("eps").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 6_000
    assert max(r["n"] for r in tasks) * 13**3 / 4 < 2_000_000


def test_few_budgets_are_one_task(spark):
    assert len(rows_by_task(mech.sweep(many_budgets(spark, 100, 7)))) == 1
    assert mech.sweep(many_budgets(spark, 0, 7)).isEmpty()


def test_cells_are_dealt_to_many_tasks(spark):
    cells = mech.design(many_budgets(spark, 600, 5), ["avg"]).drop("obj", "width", "a1")
    for made in (mech.audit(cells), mech.variances(cells), mech.clean_knots(cells), mech.report(cells)):
        assert len(rows_by_task(made)) >= 8 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["mech_audit", "mech_report", "mech_clean", "mech_avg_var", "mech_worst_var"])
def test_cells_of_many_budgets_are_dealt_by_their_number(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(mech, "PLACED_CELLS", 1_000, raising=False)
    # 4,000 budgets of 13 outputs, so a mechanism has 91 cells at most
    customers = spark.range(4_000).select((F.col("id") * 0.25).alias("c_acctbal"), F.lit(11).alias("c_nationkey"))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    out = load().queries[name](spark, str(tmp_path))
    mechanisms = out.select(F.spark_partition_id().alias("task"), *[c for c in ("obj", "eps") if c in out.columns]).distinct()
    by_task = [r["count"] for r in mechanisms.groupBy("task").count().collect()]
    assert sum(by_task) == 4_000 * {"mech_audit": 3, "mech_report": 2}.get(name, 1)
    assert max(by_task) <= 30


def test_most_cells_is_a_bound(spark):
    budgets = spark.createDataFrame([(e, n) for e in (0.5, 2.0, 6.0) for n in range(2, 14)], "eps double, n_outputs int")
    assert mech.design(budgets).count() <= mech.most_cells(budgets, 2) and mech.start_table(budgets).count() <= mech.most_cells(budgets)
    assert mech.most_cells(budgets.limit(0)) == 0


def test_catalog_sorts_no_cells(spark, no_broadcast):
    wanted = many_budgets(spark, 40, 5).withColumn("obj", F.lit("avg"))
    path = scratch_path(spark, "t-tasks")
    catalog.get_or_create(wanted.where("eps < 0.502"), path)
    cells = catalog.get_or_create(wanted, path)
    want = mech.design(wanted.select("eps", "n_outputs"), ["avg"]).select(*cells.columns)
    assert cells.count() == want.count() and cells.exceptAll(want).isEmpty()
    assert "Sort" not in cells._jdf.queryExecution().executedPlan().toString()


def test_stored_run_is_dealt_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runstore, "PART_ROWS", 1_000, raising=False)
    key = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    kept = {k: spark.conf.get(k) for k in key}
    run = {"dataset": "d", "mechanism": "pm", "mode": "index", "eps": 1.0, "t": 3.0, "n_outputs": None, "obj": None, "label_eps": 1.0, "label_n": None, "seed": 0}
    rows = spark.range(8_000, numPartitions=1).select(F.col("id").alias("k"), F.lit("train").alias("split"), *[F.lit(v).alias(c) for c, v in run.items()])
    for k, v in key.items():
        spark.conf.set(k, v)
    try:
        runstore.save_runs(rows, str(tmp_path), ["k"])
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    back = runstore.load_runs(spark, str(tmp_path))
    assert back.count() == 8_000 and back.select("k").distinct().count() == 8_000
    # one map task made all rows, and no task wrote a large share of them
    assert max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) < 4_000
