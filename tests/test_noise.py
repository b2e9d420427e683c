import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldpspark.functions import piecewise, quantised, response
from ldpspark.functions.layers import project
from ldpspark.functions.rand import row_key, uniform
from ldpspark.operators import encode, mechanism, privatise
from ldpspark.sources.catalog import design_mechanisms
from workload.sqltext import window_matrix

# (eps, t, bound, average variance, worst variance) on [-1, 1]
PM_VALUES = [
    (1, 2, 4.082988, 4.1959, 5.2236),
    (1, 3, 4.109703, 4.1529, 5.0823),
    (3, 2, 1.574434, 0.3015, 0.4929),
    (3, 3, 1.634372, 0.2640, 0.3939),
    (5, 3, 1.239640, 0.0476, 0.0761),
]
# (N, eps, width for average, a1, average variance, width for worst, worst variance)
SWEEP_VALUES = [
    (2, 1, 1, 2.163953, 4.3494, 1, 4.6827),
    (3, 3, 1, 1.157187, 0.3665, 1, 0.4560),
    (6, 3, 2, 0.462875, 0.3302, 2, 0.3745),
    (7, 1, 3, 1.178973, 4.1458, 3, 4.9529),
    (7, 2, 2, 0.619125, 0.8285, 3, 1.0913),
    (7, 4, 1, 0.376867, 0.1301, 2, 0.1743),
    (15, 3, 4, 0.217543, 0.2666, 5, 0.3856),
    (15, 5, 2, 0.161673, 0.0509, 3, 0.0740),
]


def pm_variance(m: piecewise.Piecewise, x: float) -> float:
    l, r = m.k * (x * m.big_t - 1), m.k * (x * m.big_t + 1)
    core = m.p_core * (l * l + l * r + r * r) / 3
    density = (1 - m.p_core) / (2 * m.a - 2 * m.k)
    return core + density * (2 * m.a**3 - r**3 + l**3) / 3 - x * x


@pytest.mark.parametrize("eps,t,bound,avg,worst", PM_VALUES)
def test_piecewise_parameters(eps, t, bound, avg, worst):
    m = piecewise.Piecewise(eps, t)
    xs = np.linspace(0, 1, 1001)
    v = np.array([pm_variance(m, x) for x in xs])
    assert m.a == pytest.approx(bound, abs=1e-6)
    assert np.trapezoid(v, xs) == pytest.approx(avg, abs=1e-4)
    assert v.max() == pytest.approx(worst, abs=1e-4)
    # density in the core over density in the tails is e^eps
    inside, outside = m.p_core / (2 * m.k), (1 - m.p_core) / (2 * m.a - 2 * m.k)
    assert inside / outside == pytest.approx(math.exp(eps))


def test_piecewise_noise_is_unbiased_and_bounded(spark):
    m = piecewise.Piecewise(1.0, 3.0)
    n = 20000
    for x in (-1.0, 0.0, 0.6):
        df = spark.range(n).withColumn("v", F.lit(x))
        out = project(df, [piecewise.perturb("y", F.col("v"), m.columns(), row_key("id"), 0, "v")])
        r = out.agg(F.avg("y"), F.min("y"), F.max("y"), F.var_pop("y")).head()
        sd = math.sqrt(pm_variance(m, x))
        assert abs(r[0] - x) < 4 * sd / math.sqrt(n)
        assert -m.a - 1e-12 <= r[1] and r[2] <= m.a + 1e-12
        assert r[3] == pytest.approx(sd * sd, rel=0.05)


def test_piecewise_span_and_test_rows(spark):
    m = piecewise.Piecewise(2.0, 3.0)
    df = spark.range(200).withColumn("v", F.col("id") / 100.0 - 1.0).withColumn("t", F.col("id") % 2 == 0)
    key = row_key("id")
    out = project(
        df,
        [
            piecewise.perturb("both", F.col("v"), m.columns(), key, 0, "v", test=F.col("t")),
            piecewise.perturb("train", F.col("v"), m.columns(), key, 0, "v"),
            piecewise.core_draw("test", F.col("v"), m.columns(), key, 0, "v"),
            piecewise.core_draw("mid", F.col("v"), m.columns(), key, 0, "v", mode="midpoint"),
            piecewise.perturb("wide", F.col("v") * 10, m.columns(), key, 0, "v", span=10.0),
        ],
    ).collect()
    for r in out:
        assert r["both"] == (r["test"] if r["t"] else r["train"])
        assert r["wide"] == pytest.approx(10 * r["train"])
        assert r["mid"] == pytest.approx(m.k * m.big_t * r["v"])
        assert m.k * (r["v"] * m.big_t - 1) <= r["test"] <= m.k * (r["v"] * m.big_t + 1)


@pytest.mark.parametrize("n,eps,c_avg,a1,avg,c_worst,worst", SWEEP_VALUES)
def test_sweep_values(spark, n, eps, c_avg, a1, avg, c_worst, worst):
    df = spark.createDataFrame([(float(eps), n)], "eps double, n_outputs int")
    got = {r["obj"]: r for r in mechanism.sweep(df).collect()}
    assert got["avg"]["width"] == c_avg and got["worst"]["width"] == c_worst
    assert got["avg"]["a1"] == pytest.approx(a1, abs=1e-6)
    assert got["avg"]["avg_var"] == pytest.approx(avg, abs=1e-4)
    assert got["worst"]["worst_var"] == pytest.approx(worst, abs=1e-4)


def test_design_matches_closed_form(spark):
    for eps, n, c in ((3.0, 7, 2), (1.0, 6, 3)):
        m = design_mechanisms(spark, [("avg", eps, n)])[("avg", eps, n)]
        index, a1, x, p = window_matrix(eps, n, c)
        assert m.a1 == pytest.approx(a1)
        assert np.allclose(m.p_matrix, p) and np.allclose(m.knots, x)


def test_n_of_one_is_refused(spark):
    df = spark.createDataFrame([(1.0, 1)], "eps double, n_outputs int")
    with pytest.raises(Exception, match="greater than 1"):
        mechanism.sweep(df).collect()
    with pytest.raises(ValueError):
        quantised.signed_indices(1)


@pytest.mark.parametrize("n", [2, 3, 6, 7, 15])
def test_sampling_equals_interpolate_reverse_cumulate(spark, n):
    m = design_mechanisms(spark, [("avg", 2.0, n)])[("avg", 2.0, n)]
    lookup = quantised.Lookup([m])
    values = [*np.linspace(-1.2, 1.2, 601), 0.0, 1.0, -1.0, *m.knots, *(-m.knots)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(9999, None)], "id int, v double")
    key = row_key("id")
    out = project(
        df,
        [
            quantised.sample("s", F.col("v"), lookup, key, 0, "v"),
            quantised.sample("low", F.col("v"), lookup, key, 0, "v", null_policy="lowest"),
            quantised.most_probable("b", F.col("v"), lookup),
            quantised.probabilities("p", F.col("v"), lookup),
        ],
    ).withColumn("u", uniform(0, "qm", key, "v"))
    index = quantised.signed_indices(n)
    for r in out.collect():
        if r["v"] is None:
            assert (r["s"], r["b"], r["p"], r["low"]) == (None, None, None, index[0])
            continue
        d = m.distribution(min(max(abs(r["v"]), m.knots[0]), m.knots[-1]))
        d = d[::-1] if r["v"] < 0 else d
        assert np.allclose(list(r["p"]), d, atol=1e-12) and sum(r["p"]) == pytest.approx(1.0)
        assert r["s"] == r["low"] == index[int((r["u"] >= np.cumsum(d)[:-1]).sum())]
        assert r["b"] == index[int(np.argmax(d))]
        # the mean output is the clipped input
        assert np.dot(index, d) * m.a1 == pytest.approx(min(max(r["v"], -1), 1), abs=1e-9)


def test_one_lookup_for_many_mechanisms(spark):
    keys = [("avg", 1.0, 7), ("avg", 3.0, 7), ("worst", 4.0, 7)]
    ms = design_mechanisms(spark, keys)
    df = spark.range(600).select(
        "id", (F.col("id") / 300.0 - 1.0).alias("v"), (F.col("id") % 3).cast("int").alias("w"), (F.col("id") % 2 == 0).alias("t")
    )
    key = row_key("id")
    together = quantised.Lookup([ms[k] for k in keys], F.col("w"))
    out = project(df, [quantised.sample("all", F.col("v"), together, key, 0, "v", test=F.col("t"))])
    for n, k in enumerate(keys):
        one = quantised.Lookup([ms[k]])
        out = project(out, [quantised.sample(f"one{n}", F.col("v"), one, key, 0, "v", test=F.col("t"))])
    assert all(r["all"] == r[f"one{r['w']}"] for r in out.collect())


def test_join_form_equals_unrolled_form(spark):
    budgets = spark.createDataFrame([(1.0, 7), (3.0, 7)], "eps double, n_outputs int")
    cells = mechanism.design(budgets, ["avg"]).drop("obj", "width", "a1")
    df = spark.range(400).select("id", (F.col("id") / 200.0 - 1.0).alias("v"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(3.0).alias("eps"))
    df = df.withColumn("n_outputs", F.lit(7)).unionByName(
        spark.createDataFrame([(1000, None, 1.0, 7)], "id bigint, v double, eps double, n_outputs int")
    )
    seg = privatise.segments(cells, mechanism.KEYS)
    joined = privatise.sample_by_budget(df, F.col("v"), seg, mechanism.KEYS, row_key("id"), 0, "v", "noisy")
    ms = design_mechanisms(spark, [("avg", 1.0, 7), ("avg", 3.0, 7)])
    lookup = quantised.Lookup([ms[("avg", 1.0, 7)], ms[("avg", 3.0, 7)]], F.when(F.col("eps") == 1.0, 0).otherwise(1))
    unrolled = project(df, [quantised.sample("noisy", F.col("v"), lookup, row_key("id"), 0, "v")])
    assert sorted((r["id"], r["noisy"]) for r in joined.collect() if r["noisy"] is not None) == sorted(
        (r["id"], r["noisy"]) for r in unrolled.collect() if r["noisy"] is not None
    )
    assert joined.count() == 401


def test_audit_and_clean(spark):
    good = mechanism.design(spark.createDataFrame([(3.0, 7), (2.0, 6), (1.0, 2)], "eps double, n_outputs int"))
    keys = ["obj", *mechanism.KEYS]
    good = good.select(*keys, "i", "a", "j", "p").cache()
    assert {r["feasible"] for r in mechanism.audit(good, keys).collect()} == {True}
    assert mechanism.ratio_violations(good, keys).count() == 0 and mechanism.sum_violations(good, keys).count() == 0
    # double one cell: the sum, the ratio and the symmetry break
    bad = good.withColumn("p", F.when((F.col("i") == 1) & (F.col("j") == 0), F.col("p") * 3).otherwise(F.col("p")))
    report = mechanism.audit(bad, keys).collect()
    assert {r["feasible"] for r in report} == {False}
    assert all(r["sum_violations"] == 1 and r["symmetry_violations"] == 1 for r in report)
    last = good.groupBy(*keys).agg(F.max("j").alias("last"))
    flipped = good.join(last, keys).withColumn("j", F.col("last") - F.col("j")).drop("last")
    assert {r["feasible"] for r in mechanism.audit(flipped, keys).collect()} == {False}
    cleaned = mechanism.clean_knots(flipped, keys)
    assert sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, good.select(*cleaned.columns).collect()))
    untouched = mechanism.clean_knots(good, keys)
    assert sorted(map(tuple, untouched.collect())) == sorted(map(tuple, good.select(*untouched.columns).collect()))


def test_quantised_outputs_keep_the_ratio(spark):
    m = design_mechanisms(spark, [("avg", 1.0, 7)])[("avg", 1.0, 7)]
    lookup, n = quantised.Lookup([m]), 40000
    shares = {}
    for x in (-1.0, 0.3):
        df = spark.range(n).withColumn("v", F.lit(x))
        out = project(df, [quantised.sample("y", F.col("v"), lookup, row_key("id"), 1, "v")])
        shares[x] = {r["y"]: r["count"] / n for r in out.groupBy("y").count().collect()}
        d = m.distribution(abs(x))
        d = d[::-1] if x < 0 else d
        chi = sum((shares[x][i] - p) ** 2 * n / p for i, p in zip(quantised.signed_indices(7), d))
        assert chi < 22.5  # 0.1 % point of chi-square with 6 degrees of freedom
    for i in range(-3, 4):
        assert shares[-1.0][i] / shares[0.3][i] < math.e * 1.1


@pytest.mark.parametrize("mode", ["strict", "all"])
@pytest.mark.parametrize("k", [2, 3, 6])
def test_response_keep_rate(spark, mode, k):
    n, eps = 20000, 1.0
    p = response.keep_probability(eps, k)
    df = spark.range(n).withColumn("c", (F.col("id") % k).cast("int"))
    out = project(df, [response.respond_index("y", F.col("c"), k, p, row_key("id"), 0, "c", mode=mode)])
    kept = out.agg(F.avg((F.col("c") == F.col("y")).cast("int"))).head()[0]
    want = p if mode == "strict" else p + (1 - p) / k
    assert abs(kept - want) < 4 * math.sqrt(want * (1 - want) / n)
    assert out.agg(F.min("y"), F.max("y")).head() == (0, k - 1)


def test_response_rejects_unseen_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, v string")
    cats = encode.categories(df, "v", F.col("id") < 3)
    with pytest.raises(Exception, match="unknown category"):
        privatise.respond(df, "v", cats, 1.0, row_key("id"), 0).collect()
    known = privatise.respond(df.where("id <> 3"), "v", cats, 1.0, row_key("id"), 0)
    assert {r["id"]: r["v"] for r in known.collect()}[4] is None
    assert response.effective_epsilon(1.0, 2) == pytest.approx(1.8620, abs=1e-4)


def test_single_category_stays(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string")
    cats = encode.categories(df, "v")
    assert {r["v"] for r in privatise.respond(df, "v", cats, 0.1, row_key("id"), 0).collect()} == {"a"}
