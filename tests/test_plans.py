import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldpspark.operators import mechanism, train
from ldpspark.operators.profile import usable_features
from ldpspark.plans import compare as cmp
from ldpspark.plans.config import Dataset, Run, pm_grid, qm_grid
from ldpspark.plans.privatise import fit_dataset, label_metadata, model_features, prepare, prepare_and_fit, privatise
from ldpspark.session import scratch_path
from ldpspark.sources import catalog, runstore, tables
from ldpspark.streaming.privatise import privatise_stream
from tests.test_models import brute_auc, numpy_descent


def people(spark, n=600):
    df = spark.range(n).select(
        F.col("id").alias("k"),
        ((F.col("id") * 37) % 101 / 10.0).alias("a"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 53) % 89 / 1.0).alias("b"),
        F.when(F.col("id") % 5 > 1, None).otherwise(1.0).alias("mostly_missing"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("colour"),
        ((F.col("id") * 29) % 97 / 97.0).alias("y"),
        ((F.col("id") * 31) % 4).cast("int").alias("cls"),
    )
    return df


REG = Dataset("people", ("k",), "y", ("a", "b"))


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ingest_rules(spark):
    ds = Dataset("people", ("k",), "y")
    assert prepare(people(spark), ds).columns == ["k", "a", "b", "y", "cls"]
    kept = prepare(people(spark), Dataset("people", ("k",), "y", with_categorical=True))
    assert "colour" in kept.columns and "mostly_missing" not in kept.columns
    with pytest.raises(ValueError):
        prepare(people(spark), Dataset("people", ("k",), "nothing"))


@pytest.mark.parametrize("with_categorical", [False, True])
@pytest.mark.parametrize("label, log", [("y", False), ("y", True), ("cls", False), ("colour", False)])
@pytest.mark.parametrize("features", [None, ("a", "b")])
def test_one_scan_finds_what_three_do(spark, label, log, features, with_categorical):
    ds = Dataset("people", ("k",), label, features, log_label=log, with_categorical=with_categorical)
    rows = people(spark).withColumn("half", F.when(F.col("k") % 20 < 9, 1.5)).withColumn("nan", F.when(F.col("k") % 20 > 8, 2.0).otherwise(math.nan))
    prepared, fitted = prepare_and_fit(rows, ds)
    plain = prepare(rows, ds)
    assert prepared.columns == plain.columns
    want = fit_dataset(plain, ds)
    assert (fitted.features, fitted.stats) == (want.features, want.stats)
    assert {c: v.values for c, v in fitted.feature_categories.items()} == {c: v.values for c, v in want.feature_categories.items()}
    expected = list(features) if features else usable_features(plain, label, ds.key)
    assert model_features(prepared, fitted) == expected
    if features is None:
        # 45 % and 55 % missing: used by a model, or only kept by the transform, or dropped
        assert "nan" in prepared.columns and "half" not in prepared.columns and "nan" not in expected


def test_profile_reads_the_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = people(spark, 500)
    rows = base.mapInArrow(counted, base.schema)
    prepare_and_fit(rows, Dataset("people", ("k",), "y"))
    assert seen.value == 500
    # nothing to count but the row key
    prepared, fitted = prepare_and_fit(base.select("k", "colour"), Dataset("people", ("k",), "colour"))
    assert (prepared.columns, fitted.stats, model_features(prepared, fitted)) == (["k", "colour"], {}, [])
    empty, fitted = prepare_and_fit(base.limit(0), Dataset("people", ("k",), "y"))
    assert empty.columns == ["k", "a", "b", "mostly_missing", "y", "cls"] and fitted.stats["a"].min is None


def test_categorical_features_become_one_hot(spark):
    ds = Dataset("people", ("k",), "y", with_categorical=True)
    prepared = prepare(people(spark), ds)
    out = privatise(prepared, fit_dataset(prepared, ds), [Run("pm", 1.0)])
    assert {"colour_c0", "colour_c1", "colour_c2"} <= set(out.columns) and "colour" not in out.columns
    assert out.where("colour_c0 + colour_c1 + colour_c2 <> 1").count() == 0


def test_grid_equals_single_runs_and_ignores_partitioning(spark):
    runs = [*pm_grid((1.0, 3.0), (2.0, 3.0), ("linear",), (0, 1)), *qm_grid("wine", (2.0,), (6,), (0, 1)), Run("pm", 1.0, 0, "none")]
    prepared = prepare(people(spark), REG)
    fitted = fit_dataset(prepared, REG)
    whole = privatise(prepared, fitted, runs)
    again = privatise(prepared.repartition(37), fitted, runs)
    cols = ("run", "split", "k", "a", "b", "y")
    text = [F.col(c).cast("string").alias(c) for c in cols]
    everything = rows_of(whole.select(*text), *cols)
    assert everything == rows_of(again.select(*text), *cols)
    assert len(everything) == 600 * len(runs)
    for n in (0, 3, 7, 9, len(runs) - 1):
        one = privatise(prepared, fitted, [runs[n]]).withColumn("run", F.lit(n))
        assert rows_of(one.select(*text), *cols) == [r for r in everything if r[0] == str(n)]


def test_test_labels_stay_raw_and_splits_agree(spark):
    runs = [Run("pm", 1.0, 0, "index"), Run("qm", 1.0, 3, "linear")]
    prepared = prepare(people(spark), REG)
    out = privatise(prepared, fit_dataset(prepared, REG), runs)
    test = out.where("split = 'test'").join(people(spark).select("k", F.col("y").alias("raw")), "k")
    assert test.where("y <> raw").count() == 0
    per_run = out.groupBy("run").agg(F.sort_array(F.collect_set(F.when(F.col("split") == "test", F.col("k")))).alias("ids"))
    assert len({tuple(r["ids"]) for r in per_run.collect()}) == 1
    assert out.where("split = 'train' and run = 1 and y is not null").where("y < 0 or y > 1").count() == 0


def test_null_policies(spark):
    prepared = prepare(people(spark), REG)
    fitted = fit_dataset(prepared, REG)
    gaps = F.col("k") % 11 == 0
    kept = privatise(prepared, fitted, [Run("pm", 1.0), Run("qm", 1.0)]).where(gaps)
    assert kept.where("b is not null").count() == 0
    filled = privatise(prepared, fitted, [Run("pm", 1.0), Run("qm", 1.0)], null_policy="reference").where(gaps)
    train_rows = filled.where("split = 'train'")
    assert train_rows.where("mechanism = 'pm' and not (isnan(b) or b = 0.0)").count() == 0
    assert train_rows.where("mechanism = 'qm' and b <> -3").count() == 0


def test_privatised_store_and_metadata(spark):
    runs = [*pm_grid((1.0, 2.0), (3.0,), ("index",), (0, 1)), *qm_grid("wine", (2.0,), (7,), (0,))]
    prepared = prepare(people(spark), REG)
    fitted = fit_dataset(prepared, REG)
    root = scratch_path(spark, "t-runs")
    made = privatise(prepared, fitted, runs)
    runstore.save_runs(made, root, REG.key)
    one = runstore.load_runs(spark, root, dataset="people", mechanism="pm", eps=2.0, seed=1, split="train")
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    assert rows_of(one, "k", "a") == rows_of(made.where("mechanism = 'pm' and eps = 2.0 and seed = 1 and split = 'train'"), "k", "a")
    with pytest.raises(ValueError):
        runstore.load_runs(spark, root, colour="red")
    meta = scratch_path(spark, "t-meta")
    tables.save_label_metadata(spark, label_metadata(fitted, runs), meta)
    joined = tables.attach_label_metadata(runstore.load_runs(spark, root), tables.load_label_metadata(spark, meta))
    assert joined.count() == made.count()
    assert {r["mode"] for r in joined.where("index_min is null").select("mode").distinct().collect()} == {"linear"}
    ends = joined.where("mechanism = 'qm' and mode = 'index'").select("index_min", "index_max").distinct().collect()
    assert [tuple(r) for r in ends] == [(-3.0, 3.0)]


def test_catalog_designs_only_what_is_missing(spark):
    path = scratch_path(spark, "t-cat")
    want = spark.createDataFrame([("avg", 1.0, 7), ("avg", 2.00001, 6)], "obj string, eps double, n_outputs int")
    first = catalog.get_or_create(want, path)
    n = catalog.read_catalog(spark, path).count()
    assert first.count() == n
    catalog.get_or_create(want, path)
    assert catalog.read_catalog(spark, path).count() == n
    more = want.unionByName(spark.createDataFrame([("worst", 1.0, 7)], want.schema))
    assert catalog.get_or_create(more, path).select("obj", "eps", "n_outputs").distinct().count() == 3
    stored = catalog.collect_mechanisms(catalog.get_or_create(want, path))
    fresh = catalog.design_mechanisms(spark, [("avg", 1.0, 7)])[("avg", 1.0, 7)]
    assert np.allclose(stored[("avg", 1.0, 7)].p_matrix, fresh.p_matrix)
    assert set(stored) == {("avg", 1.0, 7), ("avg", 2.0, 6)}
    assert {r["feasible"] for r in mechanism.audit(first, ["obj", *mechanism.KEYS]).collect()} == {True}


def test_csv_needs_its_label(spark):
    path = scratch_path(spark, "t-csv")
    tables.save_csv(people(spark, 20).select("k", "a", "y"), path)
    assert tables.read_csv(spark, path, "y").schema["a"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        tables.read_csv(spark, path, "label")


def test_results_and_config_sinks(spark):
    scores = spark.createDataFrame([("people", "Full", "AUC", 0.5)], "dataset string, variant string, metric string, value double")
    root, report, config = (scratch_path(spark, n) for n in ("t-scores", "t-report", "t-config"))
    tables.save_scores(scores, root)
    tables.save_scores(scores.withColumn("value", F.lit(0.7)), root)
    tables.save_scores(scores, root, train.TrainConfig("linear"))
    assert sorted(r["value"] for r in tables.load_scores(spark, root).collect()) == [0.5, 0.7]
    assert [r["value"] for r in tables.load_scores(spark, root, train.TrainConfig("linear")).collect()] == [0.5]
    summary = scratch_path(spark, "t-summary")
    for value, lr in ((0.1, 1), (0.2, 1), (0.3, 2)):
        tables.append_summary(spark.createDataFrame([("Full", value)], "variant string, auc double"), {"lr": lr}, summary)
    assert sorted(tuple(r) for r in tables.load_summary(spark, summary).collect()) == [("Full", 0.2, 1), ("Full", 0.3, 2)]
    tables.save_report(scores, report)
    assert spark.read.option("header", True).csv(report).count() == 1
    tables.save_config(spark, train.TrainConfig("linear"), config)
    assert '"model": "linear"' in spark.read.text(config).head()[0]


def by_variant(scores):
    return {(r["eps"], r["seed"], r["mode"], r["variant"], r["metric"]): r["value"] for r in scores.collect()}


def scaled(train_x, x, lo, hi):
    low, high = np.nanmin(train_x, axis=0), np.nanmax(train_x, axis=0)
    spread = np.where(high == low, 1.0, high - low)
    return lo + (x - low) / spread * (hi - lo)


def test_softmax_comparison_equals_numpy(spark):
    ds = Dataset("people", ("k",), "cls", ("a", "b"))
    runs = [Run("pm", 3.0, 0, "categorical"), Run("qm", 3.0, 1, "linear", n_outputs=7, label_n=4)]
    cfg = cmp.CompareConfig(train.TrainConfig("softmax", epochs=3))
    # only the hash of the key decides the split, so class 3 can be kept out of train
    raw = people(spark)
    prepared = prepare(raw, ds)
    fitted = fit_dataset(prepared, ds, True)
    made = privatise(prepared, fitted, runs).cache()
    got = by_variant(cmp.compare(raw, ds, runs, cfg))
    split_of = {r["k"]: r["split"] for r in made.where("run = 0").select("k", "split").collect()}
    raw_rows = [(r["k"], r["a"], r["b"], r["cls"]) for r in prepared.collect()]
    truth = {k: c for k, _, _, c in raw_rows}

    def check(rows, scale, name):
        tr = [r for r in rows if split_of[r[0]] == "train"]
        te = [r for r in rows if split_of[r[0]] == "test"]
        x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in tr], dtype=float)
        xt = np.array([[np.nan if v is None else v for v in r[1:3]] for r in te], dtype=float)
        mean = np.nanmean(x, axis=0)
        x, xt = np.where(np.isnan(x), mean, x), np.where(np.isnan(xt), mean, xt)
        if scale:
            x, xt = scaled(x, x, -3, 3), scaled(x, xt, -3, 3)
        classes = sorted({r[3] for r in tr})
        y = np.array([classes.index(r[3]) for r in tr], dtype=float)
        beta = numpy_descent("softmax", x, y, cfg.train, [np.arange(len(x))] * 3)
        z = np.hstack([np.ones((len(xt), 1)), xt]) @ beta
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        t = [truth[r[0]] for r in te]
        aucs = [brute_auc([(p[i, c], int(t[i] == c)) for i in range(len(t))]) for c in range(len(classes))]
        assert got[(*name, "Accuracy")] == pytest.approx(np.mean(np.argmax(p, axis=1) == t), abs=6e-4)
        assert got[(*name, "AUC_macro")] == pytest.approx(np.mean([a for a in aucs if a is not None]), abs=6e-4)

    check(raw_rows, True, (3.0, 0, "categorical", "Full"))
    for n, name in ((0, (3.0, 0, "categorical", "LDP-PM(T3)")), (1, (3.0, 1, "linear", "LDP-QM"))):
        rows = [(r["k"], r["a"], r["b"], r["cls"]) for r in made.where(F.col("run") == n).collect()]
        check(rows, n == 0, name)


def test_linear_comparison_with_log_label(spark):
    ds = Dataset("people", ("k",), "y", ("a", "b"), log_label=True)
    runs = [Run("pm", 5.0, 0, "index"), Run("pm", 5.0, 0, "linear"), Run("qm", 5.0, 0, "index")]
    cfg = cmp.CompareConfig(train.TrainConfig("linear", epochs=4))
    got = by_variant(cmp.compare(people(spark), ds, runs, cfg))
    assert {k[3] for k in got} == {"Full", "LDP-PM(T3)", "LDP-QM"}
    assert all(v is not None and 0 < v < 5 for v in got.values())
    twice = by_variant(cmp.compare(people(spark), ds, runs, cmp.CompareConfig(cfg.train, double_log=True)))
    changed = {k for k in got if got[k] != twice[k]}
    assert changed and all(k[2] == "linear" and k[3] == "LDP-PM(T3)" for k in changed)


def test_stored_rows_give_the_same_scores(spark):
    runs = pm_grid((2.0,), (3.0,), ("none",), (0, 1))
    ds = Dataset("people", ("k",), "flag", ("a", "b"))
    raw = people(spark).withColumn("flag", (F.col("y") > 0.5).cast("double"))
    cfg = cmp.CompareConfig(train.TrainConfig("logistic", epochs=2, batch_size=100))
    prepared = prepare(raw, ds)
    root = scratch_path(spark, "t-stored")
    runstore.save_runs(privatise(prepared, fit_dataset(prepared, ds), runs), root, ds.key)
    fresh = by_variant(cmp.compare(raw, ds, runs, cfg))
    assert fresh == by_variant(cmp.compare(raw, ds, runs, cfg, store=root)) and len(fresh) == 8
    kept = runstore.load_runs(spark, root)
    for order in (runs, runs[::-1]):
        assert fresh == by_variant(cmp.compare(raw, ds, order, cfg, privatised=kept))
    grid = cmp.training_grid(raw, ds, runs[:1], cfg, store=root, learning_rates=(0.05, 0.1), epochs=(1,))
    assert grid.groupBy("learning_rate").count().count() == 2
    alien = kept.withColumn("k", F.col("k") + 10_000)
    cut = kept.where((F.col("seed") == 0) | (F.col("k") < 20))
    for broken in (alien, cut, kept.unionByName(kept)):
        with pytest.raises(KeyError):
            cmp.compare(raw, ds, runs, cfg, privatised=broken)
    # rows of a run that is not asked for are refused, in a store they are left alone
    with pytest.raises(KeyError, match="not among the runs"):
        cmp.compare(raw, ds, runs[:1], cfg, privatised=kept)
    single = by_variant(cmp.compare(raw, ds, runs[:1], cfg, store=root))
    assert all(v == fresh[k] for k, v in single.items())
    with pytest.raises(KeyError, match="none of the runs"):
        cmp.compare(raw, ds, [Run("pm", 9.0)], cfg, store=root)
    # a run that is not there has no score; the others keep theirs
    first = kept.where("seed = 0")
    partial = by_variant(cmp.compare(raw, ds, runs, cfg, privatised=first))
    assert {k for k in fresh if partial[k] is None} and all(v in (None, fresh[k]) for k, v in partial.items())
    more = [*runs, Run("pm", 2.0, 7, "none")]
    assert {k: v for k, v in by_variant(cmp.compare(raw, ds, more, cfg, store=root)).items() if k[1] != 7} == fresh


def test_budgets_are_not_exchanged_when_stored_runs_come_in_another_order(spark):
    runs = pm_grid((0.2, 8.0), (3.0,), ("none",), (0,))
    ds = Dataset("people", ("k",), "flag", ("a", "b"))
    raw = people(spark).withColumn("flag", (F.col("a") > 5).cast("double"))
    cfg = cmp.CompareConfig(train.TrainConfig("logistic", epochs=4))
    prepared = prepare(raw, ds)
    made = privatise(prepared, fit_dataset(prepared, ds), runs)
    root = scratch_path(spark, "t-order")
    runstore.save_runs(made, root, ds.key)
    want = by_variant(cmp.compare(raw, ds, runs, cfg))
    assert want[(0.2, 0, "none", "LDP-PM(T3)", "AUC")] != want[(8.0, 0, "none", "LDP-PM(T3)", "AUC")]
    assert want == by_variant(cmp.compare(raw, ds, runs[::-1], cfg, store=root))
    assert want == by_variant(cmp.compare(raw, ds, runs[::-1], cfg, privatised=made))


def test_runs_that_differ_in_one_column_live_side_by_side(spark):
    runs = [
        Run("pm", 1.0),
        Run("pm", 1.0, t=2.0),
        Run("pm", 1.0, label_eps=2.0),
        Run("pm", 1.0, mode="index"),
        Run("pm", 1.0, seed=1),
        Run("pm", 1.000001),
        Run("qm", 1.0, n_outputs=7),
        Run("qm", 1.0, n_outputs=15, label_n=7),
        Run("qm", 1.0, n_outputs=7, obj="worst"),
        Run("qm", 1.0, n_outputs=7, label_n=3),
    ]
    assert len({runstore.run_id("people", r) for r in runs} | {runstore.run_id("others", r) for r in runs}) == 2 * len(runs)
    prepared = prepare(people(spark, 60), REG)
    fitted = fit_dataset(prepared, REG)
    root = scratch_path(spark, "t-sides")
    for saved in (runs[:1], runs[1:], runs[:1]):
        runstore.save_runs(privatise(prepared, fitted, saved), root, REG.key)
    made = privatise(prepared, fitted, runs)
    back = runstore.load_runs(spark, root)
    columns = ("mechanism", "mode", "eps", "t", "n_outputs", "obj", "label_eps", "label_n", "seed", "k", "split", "a", "y")
    assert rows_of(back, *columns) == rows_of(made, *columns) and back.count() == 60 * len(runs)
    assert runstore.forget_replaced(spark, root) == 1
    one = runstore.load_runs(spark, root, run_id=runstore.run_id("people", runs[1]))
    assert {r["t"] for r in one.collect()} == {2.0} and one.count() == 60


def test_an_unfinished_save_is_invisible(spark, monkeypatch):
    prepared = prepare(people(spark, 60), REG)
    fitted = fit_dataset(prepared, REG)
    root = scratch_path(spark, "t-half")
    runs = [Run("pm", 1.0), Run("pm", 2.0)]
    runstore.save_runs(privatise(prepared, fitted, runs[:1]), root, REG.key)
    before = rows_of(runstore.load_runs(spark, root), "k", "a", "y")

    def die(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(runstore, "stamped", die)
        with pytest.raises(RuntimeError):
            runstore.save_runs(privatise(prepared, fitted, runs).withColumn("a", F.lit(0.0)), root, REG.key)
    assert rows_of(runstore.load_runs(spark, root), "k", "a", "y") == before
    assert runstore.forget_replaced(spark, root) == 2
    assert runstore.load_runs(spark, root, eps=2.0).count() == 0
    with pytest.raises(ValueError, match="no runs"):
        runstore.load_runs(spark, scratch_path(spark, "t-none"))


def test_a_store_is_checked_without_reading_its_rows(spark):
    ds = Dataset("people", ("k",), "y", ("a", "b"))
    prepared = prepare(people(spark), ds)
    runs = [Run("pm", 1.0), Run("pm", 2.0)]
    root = scratch_path(spark, "t-sums")
    runstore.save_runs(privatise(prepared, fit_dataset(prepared, ds), runs), root, ds.key)
    listed = runstore.manifest(spark, root).collect()
    assert not runstore.differing_keys(prepared, listed, ds.key)
    for other in (prepared.where("k <> 3"), prepared.unionByName(prepared.where("k = 3")), prepared.withColumn("k", F.col("k") + 1)):
        assert len(runstore.differing_keys(other, listed, ds.key)) == 2
        with pytest.raises(KeyError, match="do not hold the raw k"):
            cmp.compare(other, ds, runs, cmp.CompareConfig(train.TrainConfig("linear", epochs=1)), store=root)
    rows = cmp.from_store(prepared, ds, runs, root)
    assert "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()


def test_label_ranges_recorded_again_replace_the_old_ones(spark):
    prepared = prepare(people(spark, 60), REG)
    fitted = fit_dataset(prepared, REG)
    runs = [Run("pm", 1.0, mode="index", t=t) for t in (2.0, 3.0)]
    path = scratch_path(spark, "t-again")
    rows = label_metadata(fitted, runs)
    tables.save_label_metadata(spark, [r | {"label_min": -5.0} for r in rows], path)
    tables.save_label_metadata(spark, rows[:1], path)
    made = tables.attach_label_metadata(privatise(prepared, fitted, runs), tables.load_label_metadata(spark, path))
    lows = {r["t"]: r["label_min"] for r in made.select("t", "label_min").distinct().collect()}
    assert lows == {2.0: rows[0]["label_min"], 3.0: -5.0} and "run_id" not in made.columns


def test_grids():
    assert len(pm_grid()) == 50 and len(pm_grid(modes=("index", "linear"), t=(2.0, 3.0))) == 200
    assert len(qm_grid("gamma")) == 50 and len(qm_grid("wine")) == 100
    assert {r.label_n for r in qm_grid("gamma")} == {2} and {r.label_n for r in qm_grid("iris")} == {3}
    assert {r.label_n for r in qm_grid("elevators", n_values=(9,))} == {9}
    off = qm_grid("gamma", eps=(1.0, 2.0), seeds=(0,), label_eps=(1.0, 2.0))
    assert sorted((r.eps, r.label_eps) for r in off) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    with pytest.raises(ValueError):
        Run("other", 1.0)
    with pytest.raises(ValueError):
        Run("pm", 1.0, mode="other")


def test_stream_equals_batch(spark):
    source, out, check = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-chk"))
    people(spark, 200).write.parquet(source)
    batch = prepare(spark.read.parquet(source), REG)
    fitted = fit_dataset(batch, REG)
    runs = [Run("pm", 1.0), Run("qm", 2.0)]
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).select("k", "a", "b", "y")
    query = privatise_stream(stream, fitted, runs).writeStream.format("parquet").option("checkpointLocation", check).start(out)
    query.processAllAvailable()
    query.stop()
    cols = ("run", "k", "split", "a", "y")
    assert rows_of(spark.read.parquet(out), *cols) == rows_of(privatise(batch, fitted, runs), *cols)
    with pytest.raises(ValueError):
        privatise_stream(batch, fitted, runs)


def test_probability_interpolation_is_unbiased_over_a_grid():
    from workload.sqltext import window_matrix

    index, a1, x, p = window_matrix(2.0, 9, 3)
    assert np.allclose([sum(i * a1 * p[k][j] for k, i in enumerate(index)) for j in range(len(x))], x)
    assert max(max(r) / min(r) for r in p) <= math.e**2 + 1e-9


def test_an_infeasible_mechanism_is_not_stored(spark):
    cells = mechanism.design(spark.createDataFrame([(1.0, 5)], "eps double, n_outputs int"), ["avg"])
    root = scratch_path(spark, "t-catalog")
    with pytest.raises(ValueError, match="infeasible"):
        catalog.store(cells.withColumn("p", F.when(F.col("i") == 1, F.col("p") * 1.2).otherwise(F.col("p"))), root)
    assert catalog.read_catalog(spark, root).isEmpty()
    catalog.store(cells, root)
    assert catalog.read_catalog(spark, root).count() == cells.count()
