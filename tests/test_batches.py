import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ldpspark.functions import permute
from ldpspark.functions.rand import row_key
from ldpspark.operators import split, train

from .test_models import numpy_descent, sample_rows


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 5000), seed=st.integers(0, 2**40), turn=st.integers(0, 50))
def test_permutation_is_one_for_any_size(n, seed, turn):
    place = permute.places(np.arange(n), n, permute.constants(seed, turn))
    assert sorted(place.tolist()) == list(range(n))


def test_permutation_has_no_visible_order():
    n = 40_000
    place = permute.places(np.arange(n), n, permute.constants(1, 0))
    other = permute.places(np.arange(n), n, permute.constants(1, 1))
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.02
    assert abs(np.corrcoef(place, other)[0, 1]) < 0.02
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.02
    # a batch draws evenly from every tenth of the ranks
    counts = np.histogram(np.flatnonzero(place < 4000), bins=10, range=(0, n))[0]
    assert ((counts > 320) & (counts < 480)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_permuted_batches_equal_numpy(spark, n):
    df = spark.range(n).withColumn("g", F.lit("a")).unionByName(spark.range(2 * n).withColumn("g", F.lit("b")))
    got = split.permuted_batches(df, row_key("id"), 3, epochs=2, seed=9, partition=["g"]).collect()
    ranked = {(r["g"], r["id"]): (r["__rank"], r["__all"]) for r in split.hash_ranks(df, row_key("id"), partition=["g"]).collect()}
    want = set()
    for (g, i), (rank, size) in ranked.items():
        for e in range(2):
            place = int(permute.places(np.array([rank]), size, permute.constants(9, e))[0])
            if place // 3 < size // 3:
                want.add((g, i, e, place // 3))
    assert {(r["g"], r["id"], r["epoch"], r["batch_id"]) for r in got} == want and len(got) == len(want)


def test_permuted_batches_rank_the_rows_once(spark):
    """Epochs add no exchange."""

    def exchanges(epochs):
        df = split.permuted_batches(spark.range(1000), row_key("id"), 8, epochs=epochs, rows=1000)
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(1) == exchanges(9)


def test_permuted_batches_of_nothing(spark):
    df = spark.range(5)
    assert split.permuted_batches(df, row_key("id"), 2, epochs=0).count() == 0
    assert split.permuted_batches(df.limit(0), row_key("id"), 2, epochs=2).count() == 0
    assert {r["batch_id"] for r in split.permuted_batches(df, row_key("id"), 0, epochs=2).collect()} == {0}


@pytest.mark.parametrize("model", train.MODELS)
def test_permuted_training_equals_numpy(spark, model):
    rows, x, y, _ = sample_rows(spark, model)
    cfg = train.TrainConfig(model, epochs=3, batch_size=64, seed=6, order="permuted")
    keyed = split.hash_ranks(rows.withColumn("exp", F.lit(0)), row_key("k"), partition=["exp"]).orderBy("k").collect()
    ranks, n = np.array([r["__rank"] for r in keyed]), len(keyed)
    batches = []
    for epoch in range(3):
        place = permute.places(ranks, n, permute.constants(6, epoch))
        batches += [np.flatnonzero(place // 64 == b) for b in range(n // 64)]
    got = train.train(rows, ["x0", "x1", "x2"], "y", cfg, row_key("k"))[0]
    assert np.allclose(got, numpy_descent(model, x, y, cfg, batches), atol=1e-9)


def test_each_model_is_permuted_by_its_seed(spark):
    rows, _, _, _ = sample_rows(spark, "logistic")
    cfg = train.TrainConfig("logistic", epochs=1, batch_size=64, order="permuted")
    two = rows.withColumns({"exp": F.lit(0), "seed": F.lit(1)}).unionByName(rows.withColumns({"exp": F.lit(1), "seed": F.lit(2)}))
    both = train.train(two, ["x0", "x1", "x2"], "y", cfg, row_key("k"))
    alone = train.train(rows.withColumn("seed", F.lit(2)), ["x0", "x1", "x2"], "y", cfg, row_key("k"))
    assert np.allclose(both[1], alone[0], atol=1e-12) and not np.allclose(both[0], both[1])


def test_an_infinite_batch_ends_its_model_alone(spark):
    rows, _, _, _ = sample_rows(spark, "linear")
    bad = rows.withColumns({"exp": F.lit(1), "x1": F.when(F.col("k") == 7, F.lit(float("inf"))).otherwise(F.col("x1"))})
    cfg = train.TrainConfig("linear", epochs=1, batch_size=64)
    got = train.train(rows.withColumn("exp", F.lit(0)).unionByName(bad), ["x0", "x1", "x2"], "y", cfg, row_key("k"))
    alone = train.train(rows, ["x0", "x1", "x2"], "y", cfg, row_key("k"))
    # the row may fall into the batch that an epoch leaves out
    assert np.allclose(got[0], alone[0]) and (1 not in got or np.isfinite(got[1]).all())
