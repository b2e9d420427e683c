import math

import pytest
from pyspark.sql import functions as F

from ldpspark.functions.rand import row_key, uniform
from ldpspark.operators import encode, ordered, profile, scale, split


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def test_draws_do_not_depend_on_partitioning(spark):
    df = ids(spark, 500)
    expr = uniform(3, "x", row_key("k"), "c").alias("u")
    runs = [sorted(map(tuple, df.repartition(p).select("k", expr).collect())) for p in (1, 4, 200)]
    assert runs[0] == runs[1] == runs[2]
    other = sorted(map(tuple, df.select("k", uniform(4, "x", row_key("k"), "c").alias("u")).collect()))
    assert other != runs[0]


def test_draws_are_uniform_and_independent(spark):
    df = ids(spark, 20000).select(
        uniform(1, "x", row_key("k"), "c", 0).alias("a"), uniform(1, "x", row_key("k"), "c", 1).alias("b")
    )
    r = df.agg(F.avg("a"), F.avg("b"), F.var_pop("a"), F.corr("a", "b"), F.min("a"), F.max("a")).head()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - 0.5) < 0.01
    assert abs(r[2] - 1 / 12) < 0.003 and abs(r[3]) < 0.03
    assert 0 <= r[4] and r[5] < 1


@pytest.mark.parametrize("n,size", [(1000, 0.2), (7, 0.2), (10, 0.25), (1, 0.2), (50, 0.0)])
def test_exact_split_size(spark, n, size):
    out = split.exact_split(ids(spark, n), row_key("k"), size)
    assert out.where("split = 'test'").count() == math.ceil(size * n)


def test_exact_split_ignores_bucket_width(spark, monkeypatch):
    df = ids(spark, 3000)
    first = split.exact_split(df, row_key("k"))
    monkeypatch.setattr(split, "CUT_DIGITS", 1)
    second = split.exact_split(df, row_key("k"))
    assert first.exceptAll(second).isEmpty() and second.where("split = 'test'").count() == 600


def test_exact_split_refuses_a_tie_at_the_cut(spark):
    df = ids(spark, 100).select((F.col("k") % 3).alias("k"))
    with pytest.raises(ValueError, match="unique"):
        split.exact_split(df, row_key("k"))


def test_batches_drop_the_incomplete_one(spark):
    out = split.assign_batches(ids(spark, 103), row_key("k"), 10, epochs=3, seed=1)
    sizes = {tuple(r[:2]): r[2] for r in out.groupBy("epoch", "batch_id").count().collect()}
    assert sizes == {(e, b): 10 for e in range(3) for b in range(10)}
    assert split.assign_batches(ids(spark, 5), row_key("k"), 10).count() == 0
    full = split.assign_batches(ids(spark, 5), row_key("k"), -1, epochs=2)
    assert full.count() == 10 and full.agg(F.max("batch_id")).head()[0] == 0


def test_batches_per_model(spark):
    df = ids(spark, 60).withColumn("exp", (F.col("k") % 2).cast("int"))
    out = split.assign_batches(df, row_key("k"), 7, partition=["exp"])
    assert {r["count"] for r in out.groupBy("exp", "batch_id").count().collect()} == {7}
    assert out.groupBy("exp").agg(F.countDistinct("batch_id").alias("n")).agg(F.min("n")).head()[0] == 4


def test_thresholds_are_strict(spark):
    rows = [(1 if i < 6 else None, 1 if i < 5 else None, 1 if i < 4 else None, None) for i in range(10)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    assert profile.columns_above(profile.missing_ratio(df), 0.4) == ["b", "c", "d"]
    assert profile.columns_above(profile.missing_ratio(df), 0.5) == ["c", "d"]
    assert profile.drop_sparse(df, exempt=["d"]).columns == ["a", "b", "d"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert profile.missing_ratio(profile.nan_to_null(df)).head()["ratio"] == pytest.approx(2 / 3)


def test_booleans_are_categories(spark):
    df = spark.createDataFrame([(1, True, "a", 2.0)], "i int, b boolean, s string, x double")
    assert profile.numeric_columns(df) == ["i", "x"]
    assert profile.categorical_columns(df) == ["b", "s"]
    with pytest.raises(ValueError):
        profile.require_column(df, "label")


def test_scaling_edges(spark):
    df = spark.createDataFrame([(5.0, 1.0, None), (5.0, 3.0, None), (5.0, None, None)], "c double, x double, n double")
    fitted = scale.fit(df, ["c", "x", "n"], ("min", "max", "mean", "std"))
    rows = scale.scale_min_max(df, fitted).collect()
    assert [r["c"] for r in rows] == [-1.0] * 3
    assert [r["x"] for r in rows] == [-1.0, 1.0, None]
    assert [r["n"] for r in rows] == [None] * 3
    assert [r["c"] for r in scale.standardise(df, fitted).select("c").collect()] == [0.0] * 3
    model = scale.scale_for_model(df, fitted, "pm", 7, ["c", "x", "n"]).collect()
    assert [r["n"] for r in model] == [0.0] * 3 and [r["x"] for r in model] == [-3.0, 3.0, 0.0]
    assert scale.scale_for_model(df, fitted, "qm", 7, ["x"]).collect()[0]["x"] == 1.0
    outside = spark.createDataFrame([(7.0,)], "x double")
    assert scale.scale_min_max(outside, {"x": fitted["x"]}).head()[0] == 5.0
    assert scale.impute_mean(df, {"x": fitted["x"]}).collect()[2]["x"] == 2.0
    with pytest.raises(ValueError):
        scale.scale_for_model(df, fitted, "other", 7, [])


def test_linear_map_degenerate(spark):
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    out = df.select(
        scale.linear_map(F.col("x"), 1.0, 1.0, 7.0, 9.0).alias("a"),
        scale.linear_map(F.col("x"), F.lit(1.0), F.lit(1.0), F.lit(7.0), F.lit(9.0)).alias("b"),
        scale.linear_map(F.col("x"), 1.0, 3.0, 7.0, 9.0).alias("c"),
    ).collect()
    assert tuple(out[0]) == (7.0, 7.0, 8.0) and tuple(out[1]) == (None, None, None)


def test_codes_by_literal_and_by_join_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{(i * 37) % 90:03d}") for i in range(400)] + [(400, None)], "k int, v string")
    train = F.col("k") % 3 != 0
    small = encode.categories(df, "v", train)
    want = sorted(map(tuple, encode.ordinal_encode(df, "v", small, "code").select("k", "code").collect()))
    monkeypatch.setattr(encode, "LITERAL_CATEGORIES", 10)
    large = encode.categories(df, "v", train)
    assert large.values is None and large.size == small.size
    coded = encode.ordinal_encode(df, "v", large, "code")
    got = sorted((r["k"], int(r["code"])) for r in coded.select("k", "code").collect())
    assert got == want
    assert coded.schema["code"].dataType == encode.ordinal_encode(df, "v", small, "code").schema["code"].dataType
    wide = [encode.one_hot_categorical(df, ["v"], {"v": c}) for c in (small, large)]
    assert wide[0].columns == wide[1].columns and wide[0].exceptAll(wide[1]).isEmpty()
    large = encode.categories(df, "v", train)
    ones = sorted(map(tuple, encode.one_hot_sparse(df, ["k"], ["v"], {"v": large}).collect()))
    assert ones == [(k, "v", code) for k, code in want if code >= 0]
    back = encode.decode(coded.where("code >= 0"), "code", large, "again")
    assert back.where("v <> again").count() == 0
    assert encode.unknown_values(df, "v", large).count() == encode.unknown_values(df, "v", small).count()


def test_prefix_sums_under_skew(spark):
    # a third of the rows share one score; scores sit in a narrow range
    rows = [("a", 0.5 + (i % 97) * 1e-9, 1) for i in range(600)] + [("a", 0.5, 1)] * 300 + [("b", i / 10, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, s double, n int").groupBy("g", "s").agg(F.sum("n").alias("n"))
    got = ordered.prefix_sums(df, ["g"], [F.col("s").asc()], {"n": "c"}).collect()
    for g in ("a", "b"):
        seen = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["s"]):
            assert r["c_before"] == seen
            seen += r["n"]
        assert {r["c_all"] for r in got if r["g"] == g} == {seen}


def test_global_row_number(spark):
    df = spark.createDataFrame([(f"x{(i * 7919) % 1000:04d}",) for i in range(1000)], "v string")
    got = ordered.global_row_number(df, [F.col("v")], "n").collect()
    assert all(int(r["v"][1:]) == r["n"] for r in got)
