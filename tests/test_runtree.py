import csv
import os

import pytest
from pyspark.sql import functions as F

from ldpspark.operators.train import TrainConfig
from ldpspark.plans import compare as cmp
from ldpspark.plans.config import Dataset, Run
from ldpspark.plans.privatise import fit_dataset, prepare, privatise
from ldpspark.sources import runstore
from ldpspark.sources.runtree import load_run_tree


def write(path, rows, header=("", "a", "y")):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def files_read(df):
    """Rows of a scan, and the number of files that it listed after pruning."""
    rows = df.collect()
    found = []

    def walk(plan):
        metrics = plan.metrics()
        if metrics.contains("numFiles"):
            found.append(metrics.apply("numFiles").value())
        children = plan.children()
        for n in range(children.size()):
            walk(children.apply(n))

    walk(df._jdf.queryExecution().executedPlan())
    assert len(found) == 1
    return rows, found[0]


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path)
    for eps in ("1.0", "2.0", "3.0"):
        for seed in range(4):
            for split, base in (("train", 0), ("test", 10)):
                rows = [(base + k, seed + k, float(eps) if k else "") for k in range(3)]
                write(f"{root}/inverse_index/wine/pm/wine_Eps{eps}_t3_Leps{eps}_seed{seed}_{split}.csv", rows)
                write(f"{root}/inverse_linear/wine/qm/wine_Eps{eps}_N7_worst_Leps2.5_LN5_seed{seed}_{split}.csv", rows)
    write(f"{root}/wine/qm/wine_Eps1.0_N2_avg_Leps1.0_LN2_seed0_train.csv", [(1, 0.5, 1)])
    # other datasets, and files that are no runs
    write(f"{root}/wine_red/pm/wine_red_Eps1.0_t3_Leps1.0_seed0_train.csv", [("x", "y")], ("", "b"))
    write(f"{root}/wine/pm/notes.csv", [("x",)], ("n",))
    with open(f"{root}/wine/pm/wine_Eps1.0_t3_Leps1.0_seed0_metadata.pkl", "wb") as f:
        f.write(b"not read")
    return root


def test_run_columns_come_from_the_names(spark, tree):
    df = load_run_tree(spark, tree, "wine", "k")
    assert df.columns == [*runstore.RUN_COLUMNS, "run_id", "split", "k", "a", "y"]
    runs = {tuple(r) for r in df.select("mechanism", "mode", "eps", "t", "n_outputs", "obj", "label_eps", "label_n", "seed").distinct().collect()}
    want = {("pm", "index", e, 3.0, None, None, e, None, s) for e in (1.0, 2.0, 3.0) for s in range(4)}
    want |= {("qm", "linear", e, None, 7, "worst", 2.5, 5, s) for e in (1.0, 2.0, 3.0) for s in range(4)}
    assert runs == want | {("qm", "categorical", 1.0, None, 2, "avg", 1.0, 2, 0)}
    assert df.count() == 24 * 6 + 1
    one = Run("qm", 2.0, 1, "linear", n_outputs=7, obj="worst", label_eps=2.5, label_n=5)
    got = df.where(F.col("run_id") == runstore.run_id("wine", one)).orderBy("k").select("split", "k", "a", "y").collect()
    assert [tuple(r) for r in got] == [(s, b + k, float(1 + k), 2.0 if k else None) for s, b in (("train", 0), ("test", 10)) for k in range(3)]


def test_a_run_is_read_by_opening_its_own_files(spark, tree):
    df = load_run_tree(spark, tree, "wine", "k")
    rows, files = files_read(df.where("mechanism = 'pm' AND eps = 2.0 AND seed = 3"))
    assert (len(rows), files) == (6, 2)
    rows, files = files_read(df.where("mode = 'linear' AND split = 'test' AND label_n = 5"))
    assert (len(rows), files) == (12 * 3, 12)
    rows, files = files_read(df.where("run_id = 'none'"))
    assert (rows, files) == ([], 0)


def test_missing_runs_and_clashing_columns(spark, tree, tmp_path):
    with pytest.raises(KeyError, match="no run of beer"):
        load_run_tree(spark, tree, "beer", "k")
    write(f"{tmp_path}/c/c_Eps1.0_t3_Leps1.0_seed0_train.csv", [(1, 2)], ("", "Seed"))
    with pytest.raises(ValueError, match="seed"):
        load_run_tree(spark, f"{tmp_path}/c", "c", "k")


def test_compare_takes_a_tree(spark, tmp_path):
    raw = spark.range(400).select(F.col("id").alias("k"), ((F.col("id") * 37) % 101 / 10.0).alias("a"), ((F.col("id") * 29) % 97 / 97.0).alias("y"))
    ds = Dataset("people", ("k",), "y", ("a",))
    runs = [Run("pm", 1.0, 0, "index"), Run("pm", 4.0, 0, "index")]
    prepared = prepare(raw, ds)
    made = privatise(prepared, fit_dataset(prepared, ds), runs)
    name = F.format_string("people_Eps%.1f_t%.1f_Leps%.1f_seed%d_%s", "eps", "t", "label_eps", "seed", "split")
    made.select(name.alias("file"), "k", "a", "y").write.option("header", True).partitionBy("file").csv(f"{tmp_path}/inverse_index/people/pm")
    cfg = cmp.CompareConfig(TrainConfig("linear", epochs=3))
    from_tree = cmp.compare(raw, ds, runs[::-1], cfg, privatised=load_run_tree(spark, str(tmp_path), "people", "k", schema="k bigint, a double, y double"))
    direct = cmp.compare(raw, ds, runs, cfg)
    assert sorted(map(tuple, from_tree.collect())) == sorted(map(tuple, direct.collect()))
