"""Sources and sinks: what is written under the shared folder comes back unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ldpspark.operators import evaluate
from ldpspark.plans import grid
from ldpspark.plans.config import Dataset, Run, pm_grid
from ldpspark.plans.privatise import fit_dataset, label_metadata, prepare, privatise
from ldpspark.session import scratch_path
from ldpspark.sources import runstore, tables
from ldpspark.sources.runtree import load_run_tree

from . import sqltext as q
from .model_queries import SCORE_ROWS, score_rows
from .noise_queries import price_rows
from .registry import query, table, wide_table

STORE_SET = Dataset("orders", ("o_orderkey",), "o_custkey", ("o_totalprice",))
STORE_RUNS = pm_grid(eps=(1.0, 3.0), t=(3.0,), modes=("index",), seeds=(0, 1))


def stored_runs(spark, sf) -> tuple[str, object]:
    prepared = prepare(wide_table(spark, sf, "orders"), STORE_SET)
    fitted = fit_dataset(prepared, STORE_SET)
    root = scratch_path(spark, "runs")
    runstore.save_runs(privatise(prepared, fitted, STORE_RUNS), root, STORE_SET.key)
    return root, fitted


@query(
    "run_store",
    f"""WITH {price_rows("split = 'train'", seed=1)} SELECT o_orderkey, round({q.pm('v', 'u0', 'u1', 3.0, 3.0)}, 6) AS o_totalprice FROM n""",
)
def run_store(spark, sf):
    """All runs written once, one run read back by its key."""
    root, _ = stored_runs(spark, sf)
    one = runstore.load_runs(spark, root, dataset="orders", mechanism="pm", mode="index", eps=3.0, seed=1, split="train")
    return one.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query(
    "run_tree",
    f"""WITH {price_rows("split = 'train'", seed=1)} SELECT o_orderkey, round({q.pm('v', 'u0', 'u1', 3.0, 3.0)}, 6) AS o_totalprice FROM n""",
)
def run_tree(spark, sf):
    """All runs written as a tree of CSV files named by run, one run read back by opening its files only."""
    prepared = prepare(wide_table(spark, sf, "orders"), STORE_SET)
    made = privatise(prepared, fit_dataset(prepared, STORE_SET), STORE_RUNS)
    root = scratch_path(spark, "tree")
    name = F.format_string("orders_Eps%.1f_t%.1f_Leps%.1f_seed%d_%s", "eps", "t", "label_eps", "seed", "split")
    rows = made.select(name.alias("file"), "o_orderkey", "o_totalprice", "o_custkey")
    rows.write.option("header", True).partitionBy("file").csv(f"{root}/inverse_index/orders/pm")
    tree = load_run_tree(spark, root, "orders", "o_orderkey", schema="o_orderkey bigint, o_totalprice double, o_custkey double")
    one = tree.where((F.col("mechanism") == "pm") & (F.col("mode") == "index") & (F.col("eps") == 3.0) & (F.col("seed") == 1) & (F.col("split") == "train"))
    return one.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


_ASKED = """SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'wine' WHEN 1 THEN 'gamma' WHEN 2 THEN 'Beijing_housing' ELSE c_mktsegment END AS dataset,
      round((c_acctbal + 1000.0e0) / 2500.0e0 + 0.5e0, 4) AS eps, 1.0e0 + c_nationkey % 3 AS label_eps FROM customer"""


@query(
    "grid_table",
    f"""WITH a AS ({_ASKED}), s(dataset, label_n, regression, log_label) AS (VALUES ('wine', 7, TRUE, FALSE), ('gamma', 2, FALSE, FALSE),
        ('Beijing_housing', NULL, FALSE, TRUE)),
      r AS (SELECT a.*, label_n, coalesce(regression, FALSE) AS reg, coalesce(log_label, FALSE) AS lg FROM a LEFT JOIN s ON s.dataset = a.dataset),
      m(mode, reg) AS (VALUES ('index', TRUE), ('linear', TRUE), ('linear', FALSE))
    SELECT r.dataset, m.mode, r.eps, r.label_eps, n.n_outputs, coalesce(r.label_n, n.n_outputs) AS label_n, CAST(lg AS INTEGER) AS log_label, d.seed
    FROM r JOIN m ON m.reg = r.reg, (VALUES (5), (64)) n(n_outputs), (VALUES (0), (1)) d(seed)""",
)
def grid_table(spark, sf):
    """The runs that customers ask for, with the settings of their datasets."""
    place = F.col("c_custkey") % 4
    name = F.when(place == 0, "wine").when(place == 1, "gamma").when(place == 2, "Beijing_housing").otherwise(F.col("c_mktsegment"))
    asked = table(spark, sf, "customer").select(
        name.alias("dataset"),
        F.round((F.col("c_acctbal") + 1000.0) / 2500.0 + 0.5, 4).alias("eps"),
        (1.0 + F.col("c_nationkey") % 3).alias("label_eps"),
    )
    runs = grid.qm_runs(asked, grid.usual_settings(spark), n_values=(5, 64), seeds=(0, 1))
    return runs.select("dataset", "mode", "eps", "label_eps", "n_outputs", "label_n", F.col("log_label").cast("int").alias("log_label"), "seed")


# each differs from the first in one column of the run key
TWINS = [
    Run("pm", 1.0, 0, "index", t=3.0),
    Run("pm", 1.0, 0, "index", t=2.0),
    Run("pm", 1.0, 0, "index", t=3.0, label_eps=2.0),
    Run("pm", 1.0, 0, "index", t=3.0, label_n=7),
    Run("qm", 1.0, 0, "index", n_outputs=7, obj="avg"),
    Run("qm", 1.0, 0, "index", n_outputs=15, obj="avg", label_n=7),
    Run("qm", 1.0, 0, "index", n_outputs=7, obj="worst"),
    Run("qm", 1.0, 0, "index", n_outputs=7, obj="avg", label_n=5),
]


def _twins_sql() -> str:
    values = ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else q.d(v) if isinstance(v, float) else str(v)
                        for v in (r.mechanism, r.eps, r.t, r.n_outputs, r.obj, r.label_eps, r.label_n)) + ")"
        for r in TWINS
    )
    noisy = " UNION ALL ".join(
        f"SELECT {q.d(t)} AS t, sum(CAST(round(x * 1000) AS BIGINT)) AS checked FROM (SELECT {q.pm('v', 'u0', 'u1', 1.0, t)} AS x FROM n)" for t in (3.0, 2.0)
    )
    return f"""WITH {price_rows("split = 'train'", seed=0)}, sums AS ({noisy}),
    r AS (SELECT * FROM (VALUES {values}) r(mechanism, eps, t, n_outputs, obj, label_eps, label_n))
    SELECT r.mechanism, r.eps, r.t, r.n_outputs, r.obj, r.label_eps, r.label_n, (SELECT count(*) FROM orders) AS n_rows,
      CAST(sums.checked AS BIGINT) AS checked FROM r LEFT JOIN sums ON sums.t = r.t"""


@query("run_store_twins", _twins_sql())
def run_store_twins(spark, sf):
    """Runs that differ in one column of their key, each saved twice: all of them come back, once."""
    prepared = prepare(wide_table(spark, sf, "orders"), STORE_SET)
    fitted = fit_dataset(prepared, STORE_SET)
    root = scratch_path(spark, "twins")
    for runs in (TWINS, TWINS[::-1]):
        runstore.save_runs(privatise(prepared, fitted, runs), root, STORE_SET.key)
    noisy = F.when((F.col("mechanism") == "pm") & (F.col("split") == "train"), F.round(F.col("o_totalprice") * 1000).cast("bigint"))
    keys = ["mechanism", "eps", "t", "n_outputs", "obj", "label_eps", "label_n"]
    return runstore.load_runs(spark, root, dataset="orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(noisy).alias("checked"))


_A = {e: q.pm_constants(e, 3.0)["a"] for e in (1.0, 3.0)}


@query(
    "metadata_store",
    f"""WITH s AS (SELECT CAST(o_custkey AS DOUBLE) AS y, {q.split(q.text('o_orderkey'))} AS split FROM orders),
      f AS (SELECT min(CASE WHEN split = 'train' THEN y END) AS label_min, max(CASE WHEN split = 'train' THEN y END) AS label_max, count(*) AS n FROM s)
    SELECT eps, seed, n AS n_rows, CASE WHEN seed = 0 THEN label_min END AS label_min, CASE WHEN seed = 0 THEN label_max END AS label_max,
      CASE WHEN seed = 0 THEN round(-a, 9) END AS index_min, CASE WHEN seed = 0 THEN round(a, 9) END AS index_max
    FROM f, (VALUES (1.0e0, {q.d(_A[1.0])}), (3.0e0, {q.d(_A[3.0])})) e(eps, a), (VALUES (0), (1)) sd(seed)""",
)
def metadata_store(spark, sf):
    """Runs of seed 1 have no stored metadata: their bounds stay NULL."""
    root, fitted = stored_runs(spark, sf)
    path = scratch_path(spark, "metadata")
    tables.save_label_metadata(spark, label_metadata(fitted, [r for r in STORE_RUNS if r.seed == 0]), path)
    rows = tables.attach_label_metadata(runstore.load_runs(spark, root), tables.load_label_metadata(spark, path))
    return rows.groupBy("eps", "seed").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("label_min").alias("label_min"),
        F.max("label_max").alias("label_max"),
        F.round(F.min("index_min"), 9).alias("index_min"),
        F.round(F.max("index_max"), 9).alias("index_max"),
    )


@query("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_roundtrip(spark, sf):
    """Header and given types on read; a missing label column would be an error."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    path = scratch_path(spark, "csv")
    tables.save_csv(table(spark, sf, "orders").select(*columns), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return tables.read_csv(spark, path, "o_totalprice", schema)


@query(
    "csv_inferred",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""",
)
def csv_inferred(spark, sf):
    """Types as read from the values."""
    path = scratch_path(spark, "csv")
    tables.save_csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return tables.read_csv(spark, path, "o_totalprice")


@query("score_store", f"""WITH s AS ({SCORE_ROWS}) SELECT variant, round_even(avg(rmse), 3) AS "RMSE", round_even(avg(mae), 3) AS "MAE", 64 AS batch_size FROM s GROUP BY variant""")
def score_store(spark, sf):
    """Scores appended, averaged from the store, and the mean table appended to the summary."""
    scores, summary = scratch_path(spark, "scores"), scratch_path(spark, "summary")
    tables.save_scores(score_rows(spark, sf).withColumn("dataset", F.lit("orders")), scores)
    means = evaluate.seed_means(tables.load_scores(spark, scores).where(F.col("dataset") == "orders"))
    tables.append_summary(evaluate.wide_report(means, ["RMSE", "MAE"]), {"batch_size": 64}, summary)
    return tables.load_summary(spark, summary)
