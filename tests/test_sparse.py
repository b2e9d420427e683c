import numpy as np
import pytest
from pyspark.sql import functions as F

from ldpspark.operators import encode, sparse, train


def category_rows(spark, model, n=600):
    """Two dense features, a hot category that holds a third of the rows, NULL categories, missing cells."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a = "hot" if i % 3 == 0 else f"c{rng.integers(40)}"
        b = None if i % 11 == 0 else int(rng.integers(5))
        x0, x1 = rng.normal(), (None if i % 17 == 0 else float("nan") if i % 19 == 0 else rng.normal())
        z = x0 + (a == "hot") - (b or 0) / 3 + rng.normal()
        y = None if i % 23 == 0 else (float(z > 0) if model == "logistic" else z / 4)
        rows.append((i, a, b, float(x0), None if x1 is None else float(x1), y))
    return spark.createDataFrame(rows, "k int, a string, b int, x0 double, x1 double, y double")


@pytest.mark.parametrize("model", ["linear", "logistic"])
def test_sparse_training_equals_one_hot_columns(spark, model):
    df = category_rows(spark, model)
    fitted = {c: encode.categories(df, c) for c in ("a", "b")}
    cfg = train.TrainConfig(model, epochs=4, learning_rate=0.3)
    got = sparse.train_sparse(df, ["k"], ["x0", "x1"], ["a", "b"], fitted, "y", cfg)
    wide = encode.one_hot_categorical(df, ["a", "b"], fitted)
    hot = [f"{c}_{v}" for c in ("a", "b") for v in fitted[c].listed()]
    want = train.train(wide, ["x0", "x1", *hot], "y", cfg)[0]
    assert np.allclose(got.dense[0], want[:3], atol=1e-9)
    found = {(r["column"], r["code"]): r["beta"] for r in got.table.collect()}
    places = [(c, n) for c in ("a", "b") for n in range(fitted[c].size)]
    assert np.allclose([found[p] for p in places], want[3:], atol=1e-9) and len(found) == len(places)

    scored = sparse.score_sparse(df, ["k"], ["x0", "x1"], ["a", "b"], fitted, got, model).orderBy("k").collect()
    for r in scored:
        if r["x1"] is None or np.isnan(r["x1"]):
            assert r["prediction"] is None
            continue
        z = want[0] + want[1] * r["x0"] + want[2] * r["x1"]
        z += found[("a", fitted["a"].listed().index(r["a"]))]
        z += 0 if r["b"] is None else found[("b", fitted["b"].listed().index(r["b"]))]
        assert np.isclose(r["prediction"], z if model == "linear" else 1 / (1 + np.exp(-z)))


def test_models_of_one_table_do_not_mix(spark):
    df = category_rows(spark, "logistic").fillna({"y": 0.0})
    fitted = {"a": encode.categories(df, "a")}
    both = df.withColumn("exp", F.lit(0)).unionByName(df.withColumns({"exp": F.lit(2), "y": 1 - F.col("y")}))
    bad = df.withColumns({"exp": F.lit(1), "x0": F.when(F.col("k") == 4, F.lit(float("inf"))).otherwise(F.col("x0"))})
    cfg = train.TrainConfig("linear", epochs=3)
    got = sparse.train_sparse(both.unionByName(bad), ["k"], ["x0"], ["a"], fitted, "y", cfg)
    alone = sparse.train_sparse(df, ["k"], ["x0"], ["a"], fitted, "y", cfg)
    # the infinite model ends alone
    assert set(got.dense) == {0, 2} and np.allclose(got.dense[0], alone.dense[0])
    tables = {e: {(r["column"], r["code"]): r["beta"] for r in got.table.where(F.col("exp") == e).collect()} for e in (0, 1, 2)}
    want = {(r["column"], r["code"]): r["beta"] for r in alone.table.collect()}
    assert tables[1] == {} and tables[0].keys() == want.keys() == tables[2].keys()
    assert all(abs(tables[0][p] - want[p]) < 1e-9 for p in want)
    scored = sparse.score_sparse(bad, ["k"], ["x0"], ["a"], fitted, got, "linear")
    assert scored.where(F.col("prediction").isNotNull()).count() == 0


def test_many_categories_need_no_list(spark, monkeypatch):
    """A value per row: codes and coefficients stay in Spark."""
    monkeypatch.setattr(encode.Categories, "listed", lambda self: pytest.fail("categories were listed"))
    n = 100_000
    df = spark.range(n).select(
        F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("a"), F.sin("id").alias("x0"), (F.col("id") % 2).cast("double").alias("y")
    )
    fitted = {"a": encode.categories(df, "a")}
    assert fitted["a"].values is None and fitted["a"].size == n
    got = sparse.train_sparse(df, ["k"], ["x0"], ["a"], fitted, "y", train.TrainConfig("logistic", epochs=1))
    assert got.table.count() == n
    # every category has one row: its gradient is that row's error, one half up or down
    sizes = [abs(r[0]) for r in got.table.select("beta").distinct().limit(10).collect()]
    assert np.allclose(sizes, 0.05 * 0.5 / n)


def test_empty_table_and_refusals(spark):
    df = category_rows(spark, "linear").limit(0)
    fitted = {"a": encode.categories(df, "a")}
    got = sparse.train_sparse(df, ["k"], ["x0"], ["a"], fitted, "y", train.TrainConfig("linear", epochs=2))
    assert got.dense == {} and got.table.count() == 0
    with pytest.raises(ValueError, match="sparse"):
        sparse.train_sparse(df, ["k"], ["x0"], ["a"], fitted, "y", train.TrainConfig("softmax"))
    with pytest.raises(ValueError, match="full batches"):
        sparse.train_sparse(df, ["k"], ["x0"], ["a"], fitted, "y", train.TrainConfig("linear", batch_size=8))
