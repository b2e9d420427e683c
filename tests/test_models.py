import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldpspark.functions.rand import row_key
from ldpspark.operators import evaluate, lookup, score, split, train


def numpy_descent(model, x, y, cfg, batches):
    """Plain array version of the three descents; ``batches`` lists row positions per step."""
    xb = np.hstack([np.ones((len(x), 1)), x])
    if model == "softmax":
        k = int(y.max()) + 1
        hot = np.eye(k)[y.astype(int)]
        beta = np.zeros((xb.shape[1], k))
        beta[0] = np.log(np.clip(hot.mean(axis=0), 1e-9, 1 - 1e-9))
    else:
        hot = y.astype(float)
        beta = np.zeros(xb.shape[1])
        mean = hot.mean()
        beta[0] = mean if model == "linear" else np.log(np.clip(mean, 1e-9, 1 - 1e-9) / (1 - np.clip(mean, 1e-9, 1 - 1e-9)))
    for rows in batches:
        z = xb[rows] @ beta
        if model == "softmax":
            z = np.clip(z, -500, 500)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
        else:
            p = z if model == "linear" else 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        factor = 2 if model == "linear" else 1
        reg = factor * cfg.regularization * beta
        reg[0] = 0
        g = factor * xb[rows].T @ (p - hot[rows]) / len(rows) + reg
        norm = np.linalg.norm(g)
        if norm > cfg.gradient_clip:
            g = g * cfg.gradient_clip / norm
        beta = np.clip(beta - cfg.learning_rate * g, -cfg.parameter_clip, cfg.parameter_clip)
    return beta


def sample_rows(spark, model, n=400, d=3):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    z = x @ np.arange(1, d + 1) + rng.normal(size=n)
    y = {"linear": z / 4, "logistic": (z > 0).astype(float), "softmax": np.digitize(z, [-2, 0, 2]).astype(float)}[model]
    cols = [f"x{k}" for k in range(d)]
    schema = "k int, " + ", ".join(f"{c} double" for c in cols) + ", y double"
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], schema)
    return df, x, y, cols


@pytest.mark.parametrize("model", train.MODELS)
@pytest.mark.parametrize("limit", [300, 1])
def test_full_batch_equals_numpy(spark, monkeypatch, model, limit):
    monkeypatch.setattr(train, "MAX_AGGREGATES", limit)  # 1 forces the per-partition numpy path
    df, x, y, cols = sample_rows(spark, model)
    cfg = train.TrainConfig(model, epochs=4, learning_rate=0.3)
    got = train.train(df, cols, "y", cfg)[0]
    want = numpy_descent(model, x, y, cfg, [np.arange(len(x))] * 4)
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("model", train.MODELS)
def test_mini_batches_equal_numpy(spark, model):
    df, x, y, cols = sample_rows(spark, model)
    cfg = train.TrainConfig(model, epochs=2, batch_size=150, learning_rate=0.2, seed=3)
    assigned = split.assign_batches(df, row_key("k"), 150, 2, 3).collect()
    order = {}
    for r in assigned:
        order.setdefault((r["epoch"], r["batch_id"]), []).append(r["k"])
    assert len(order) == 4 and all(len(v) == 150 for v in order.values())
    got = train.train(df, cols, "y", cfg, row_key("k"))[0]
    want = numpy_descent(model, x, y, cfg, [np.array(order[b]) for b in sorted(order)])
    assert np.allclose(got, want, atol=1e-9)


def test_many_models_at_once_equal_single_ones(spark):
    df, _, _, cols = sample_rows(spark, "softmax")
    stacked = df.withColumn("exp", (F.col("k") % 3).cast("int"))
    # model 2 never sees class 3
    stacked = stacked.where(~((F.col("exp") == 2) & (F.col("y") == 3)))
    cfg = train.TrainConfig("softmax", epochs=3)
    together = train.train_softmax(stacked, cols, "y", cfg)
    for e in range(3):
        alone = train.train_softmax(stacked.where(F.col("exp") == e).drop("exp"), cols, "y", cfg)[0]
        assert np.allclose(together[e][:, : alone.shape[1]], alone, atol=1e-9)
    assert together[2][0, 3] == train.ABSENT_BIAS
    probs = score.predict_softmax(stacked.where("exp = 2"), cols, together)
    assert probs.agg(F.max("prob3")).head()[0] < 1e-200


def test_batch_larger_than_data_leaves_the_start(spark):
    df, _, y, cols = sample_rows(spark, "logistic", n=50)
    cfg = train.TrainConfig("logistic", epochs=2, batch_size=64)
    beta = train.train(df, cols, "y", cfg, row_key("k"))[0]
    assert np.allclose(beta, [math.log(y.mean() / (1 - y.mean())), 0, 0, 0])
    linear = train.train(df, cols, "y", train.TrainConfig("linear", epochs=2, batch_size=64), row_key("k"))[0]
    assert np.allclose(linear, [y.mean(), 0, 0, 0])


def test_refusals(spark):
    df, _, _, cols = sample_rows(spark, "linear", n=50)
    with pytest.raises(ValueError, match="unknown model"):
        train.TrainConfig("tree")
    with pytest.raises(ValueError, match="max_steps"):
        train.train(df, cols, "y", train.TrainConfig("linear", epochs=9, batch_size=5, max_steps=10), row_key("k"))
    with pytest.raises(ValueError, match="row key"):
        train.train(df, cols, "y", train.TrainConfig("linear", epochs=1, batch_size=5))


def test_parameter_clip_includes_the_bias(spark):
    df = spark.createDataFrame([(float(i), 50.0 + i) for i in range(20)], "x double, y double")
    beta = train.train_linear(df, ["x"], "y", train.TrainConfig("linear", epochs=1))[0]
    assert beta[0] == 1.0


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_youden(pairs):
    p, n = sum(y for _, y in pairs), sum(1 - y for _, y in pairs)
    best = (0.0, math.inf)
    for t in sorted({s for s, _ in pairs}, reverse=True):
        j = sum(y for s, y in pairs if s >= t) / p - sum(1 - y for s, y in pairs if s >= t) / n
        if j > best[0]:
            best = (j, t)
    return best


def test_ranking_metrics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    groups = {
        "mixed": [(float(s), int(y)) for s, y in zip(rng.integers(0, 30, 300) / 30, rng.integers(0, 2, 300))],
        "one_hot_score": [(0.5, int(y)) for y in rng.integers(0, 2, 100)] + [(float(s), 1) for s in rng.random(50)],
        "narrow": [(0.5 + float(s) * 1e-12, int(s > 40)) for s in rng.integers(0, 90, 200)],
        "inverted": [(1.0 - y / 2, y) for y in [0, 1] * 20],
        "only_positive": [(0.1 * i, 1) for i in range(5)],
    }
    rows = [(g, s, y) for g, pairs in groups.items() for s, y in pairs]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r["g"]: r for r in evaluate.binary_report(df, "y", "s", ["g"]).collect()}
    for g, pairs in groups.items():
        want = brute_auc(pairs)
        assert got[g]["auc"] == (want if want is None else pytest.approx(want))
        if want is None:
            assert got[g]["threshold"] == 0.5 and got[g]["youden_j"] is None
            threshold = 0.5
        else:
            j, threshold = brute_youden(pairs)
            assert got[g]["youden_j"] == pytest.approx(j) and got[g]["threshold"] == threshold
        hits = sum((s >= threshold) == (y == 1) for s, y in pairs) / len(pairs)
        assert got[g]["accuracy"] == pytest.approx(hits)
    points = evaluate.roc_points(df, "y", "s", ["g"]).where("g = 'mixed'").collect()
    assert len(points) == len({s for s, _ in groups["mixed"]}) + 1
    assert (max(r["fpr"] for r in points), max(r["tpr"] for r in points)) == (1.0, 1.0)


def test_macro_auc_skips_undefined_classes_and_unknown_rows(spark):
    rows = [(0, 0.9, 0.1, 0.0), (1, 0.2, 0.8, 0.0), (1, 0.7, 0.3, 0.0), (0, 0.6, 0.4, 0.0), (-1, 0.1, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "t int, prob0 double, prob1 double, prob2 double")
    kept = evaluate.macro_auc(df, "t", 3).head()[0]
    assert kept == pytest.approx((0.75 + 0.75) / 2)
    all_rows = evaluate.macro_auc(df, "t", 3, drop_unknown=False).head()[0]
    assert all_rows != pytest.approx(kept)
    single = spark.createDataFrame([(0, 0.4, 0.6)], "t int, prob0 double, prob1 double")
    assert evaluate.macro_auc(single, "t", 2).head()[0] is None


def test_label_inversion(spark):
    df = spark.createDataFrame([(-9.0,), (0.0,), (9.0,), (None,)], "p double")
    got = [r[0] for r in df.select(score.invert_label(F.col("p"), -3, 3, 10, 40)).collect()]
    assert got == [10.0, 25.0, 40.0, None]
    flat = [r[0] for r in df.select(score.invert_label(F.col("p"), 2, 2, 10, 40)).collect()]
    assert flat == [10.0, 10.0, 10.0, None]
    null = F.lit(None).cast("double")
    same = [r[0] for r in df.select(score.invert_label(F.col("p"), null, null, null, null)).collect()]
    assert same == [-9.0, 0.0, 9.0, None]


def test_sigmoid_survives_huge_scores(spark):
    df = spark.createDataFrame([(0, 1e6), (1, -1e6)], "k int, x double")
    out = score.predict_logistic(df, ["x"], {0: np.array([0.0, 1.0])}).orderBy("k").collect()
    assert out[0]["prob"] == 1.0 and 0 < out[1]["prob"] < 1e-200


def test_report_rounding_and_names(spark):
    rows = [("Full", "AUC", 0.0625), ("Full", "AUC", 0.0635), ("LDP-QM", "AUC", None), ("LDP-QM", "AUC", 0.5)]
    df = spark.createDataFrame(rows, "variant string, metric string, value double")
    got = [r["value"] for r in evaluate.rounded(df).collect()]
    assert got == [0.062, 0.064, None, 0.5]
    wide = evaluate.wide_report(evaluate.seed_means(df), ["AUC"]).collect()
    assert [tuple(r) for r in wide] == [("Full", 0.063), ("LDP-QM", 0.5)]
    names = spark.createDataFrame([("raw",), ("pm_t3",), ("qm",)], "mechanism string")
    assert [r[0] for r in names.select(evaluate.variant_column()).collect()] == ["Full", "LDP-PM(T3)", "LDP-QM"]
    assert [evaluate.variant_name(m) for m in ("raw", "pm_t2", "qm")] == ["Full", "LDP-PM(T2)", "LDP-QM"]


def test_rows_by_id(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    ids = spark.createDataFrame([(2,)], "k int")
    assert [tuple(r) for r in lookup.select_by_ids(raw, ids, "k").collect()] == [(2, "b")]
    for absent in (3, None):
        with pytest.raises(Exception, match="lacks an id"):
            lookup.select_by_ids(raw, spark.createDataFrame([(absent,)], "k int"), "k").collect()


@pytest.mark.parametrize("model", train.MODELS)
@pytest.mark.parametrize("holes", [("x0",), ("y",), ("x1", "y")])
def test_missing_cells_give_one_model_on_both_paths(spark, monkeypatch, model, holes):
    df, _, _, cols = sample_rows(spark, model, n=200)
    gap = F.when(F.col("k") % 17 == 3, F.lit(float("nan")))
    for c in holes:
        df = df.withColumn(c, F.when(F.col("k") % 19 != 5, F.coalesce(gap, F.col(c))))
    df = df.repartition(4)
    cfg = train.TrainConfig(model, epochs=3, learning_rate=0.3)
    built_in = train.train(df, cols, "y", cfg)[0]
    monkeypatch.setattr(train, "MAX_AGGREGATES", 1)
    by_task = train.train(df, cols, "y", cfg)[0]
    assert np.isfinite(built_in).all() and np.allclose(built_in, by_task, atol=1e-9)


@pytest.mark.parametrize("model", train.MODELS)
@pytest.mark.parametrize("width", [2, 30])
def test_one_infinite_model_leaves_the_others_alone(spark, model, width):
    rng = np.random.default_rng(width)
    names = [f"x{c}" for c in range(width)]
    rows = [(exp, *rng.normal(size=width).tolist(), float(k % 3 if model == "softmax" else k % 2)) for exp in (0, 1, 2) for k in range(40)]
    bad = [list(r) for r in rows]
    bad[45][1] = float("inf")
    bad = [tuple(r) if r[0] != 2 else (*r[:-1], None) for r in bad]
    schema = f"exp int, {', '.join(f'{n} double' for n in names)}, y double"
    cfg = train.TrainConfig(model, epochs=3)
    good = train.train(spark.createDataFrame(rows, schema), names, "y", cfg)
    left = train.train(spark.createDataFrame(bad, schema), names, "y", cfg)
    # linear moments skip missing labels cell by cell and keep the model
    assert set(left) - {2} == {0} and np.allclose(left[0], good[0])
    assert train.train(spark.createDataFrame(bad, schema).where("exp = 1"), names, "y", cfg) == {}


def test_corners_of_the_envelope_are_where_the_maximum_changes():
    from ldpspark.functions.quantised import envelope_corners

    rng = np.random.default_rng(0)
    for n in (2, 5, 64):
        for _ in range(30):
            slope, right = rng.normal(size=n), rng.normal(size=n)
            corners = envelope_corners(slope, right, 0.0, 1.0)
            grid = np.linspace(0, 1, 4001)
            best = np.argmax(right[:, None] + slope[:, None] * (grid - 1.0), axis=0)
            changes = grid[1:][np.diff(best) != 0]
            assert len(corners) >= len(changes) and all(np.abs(np.array(corners) - c).min() < 1e-3 for c in changes)
            assert corners == sorted(corners) and len(corners) < n
