"""Mechanisms applied to tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ldpspark.functions import piecewise, quantised, response
from ldpspark.functions.layers import project
from ldpspark.functions.rand import row_key, uniform
from ldpspark.operators import encode, mechanism, privatise, profile, scale, split
from ldpspark.sources.catalog import design_mechanisms

from . import sqltext as q
from .prepare_queries import EVENT, LINE_COLS, LINE_IDS, LINE_SPLIT, ORDER, is_train, line_key, line_table
from .registry import query, table, wide_table

# ---------------------------------------------------------------- piecewise mechanism


def order_table(spark, sf):
    orders = wide_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate")
    return split.hash_split(orders, row_key("o_orderkey"))


ORDER_SPLIT = f"SELECT *, {q.split(ORDER)} AS split FROM orders"
PRICE_FIT = "f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM s WHERE split = 'train')"


def noise_columns(seed: int, stream: str, key: str, col: str) -> str:
    hx = q.h(seed, stream, key, col)
    return f"{q.u(hx, 0)} AS u0, {q.u(hx, 1)} AS u1"


def price_rows(where: str, col: str = "o_totalprice", stream: str = "pm", seed: int = 0) -> str:
    """CTEs s, f, n(o_orderkey, split, v, u0, u1)."""
    return f"""s AS ({ORDER_SPLIT}), {PRICE_FIT},
      n AS (SELECT o_orderkey, split, o_totalprice, lo, hi, {q.minmax('o_totalprice', 'lo', 'hi')} AS v, {noise_columns(seed, stream, ORDER, col)}
        FROM s, f WHERE {where})"""


@query(
    "pm_params",
    """WITH b AS (SELECT c_custkey, (c_acctbal + 1000.0e0) / 2500.0e0 + 0.5e0 AS eps, 2.0e0 + c_custkey % 2 AS t FROM customer),
      e AS (SELECT c_custkey, exp(eps) AS e, exp(eps / t) AS tt FROM b)
    SELECT c_custkey, round(tt, 8) AS pm_t, round((e + tt) / (tt * (e - 1.0e0)), 8) AS pm_k,
      round((e + tt) * (tt + 1.0e0) / (tt * (e - 1.0e0)), 8) AS pm_a, round(e / (e + tt), 8) AS pm_p FROM e""",
)
def pm_params(spark, sf):
    """Every customer with a budget and variant of their own."""
    eps = (F.col("c_acctbal") + 1000.0) / 2500.0 + 0.5
    params = piecewise.parameter_columns(eps, 2.0 + F.col("c_custkey") % 2)
    return table(spark, sf, "customer").select("c_custkey", *[F.round(e, 8).alias(n) for n, e in params.items()])


@query(
    "pm_perturb",
    f"WITH {price_rows('TRUE')} SELECT o_orderkey, split, round({q.pm('v', 'u0', 'u1', 1.0, 3.0)}, 6) AS noisy FROM n WHERE split = 'train'",
)
def pm_perturb(spark, sf):
    orders = order_table(spark, sf)
    fitted = scale.fit(orders, ["o_totalprice"], where=is_train())
    out = privatise.perturb_pm(
        orders.where(is_train()), ["o_totalprice"], fitted, piecewise.Piecewise(1.0, 3.0), row_key("o_orderkey"), 0
    )
    return out.select("o_orderkey", "split", F.round("o_totalprice", 6).alias("noisy"))


def _core_sql() -> str:
    l, r = q.pm_core("v", 1.0, 3.0)
    return f"""WITH {price_rows("split = 'test'")} SELECT o_orderkey, round({l} + ({r} - {l}) * u0, 6) AS drawn,
      round(({l} + {r}) / 2.0e0, 6) AS middle FROM n"""


@query("pm_test", _core_sql())
def pm_test(spark, sf):
    orders = order_table(spark, sf)
    s = scale.fit(orders, ["o_totalprice"], where=is_train())["o_totalprice"]
    v, params, key = privatise.scaled("o_totalprice", s), piecewise.Piecewise(1.0, 3.0).columns(), row_key("o_orderkey")
    out = project(
        orders.where(~is_train()),
        [
            piecewise.core_draw("drawn", v, params, key, 0, "o_totalprice"),
            piecewise.core_draw("middle", v, params, key, 0, "o_totalprice", mode="midpoint"),
        ],
    )
    return out.select("o_orderkey", F.round("drawn", 6).alias("drawn"), F.round("middle", 6).alias("middle"))


def _line_fit(cols) -> str:
    return f"SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in cols)} FROM s WHERE split = 'train'"


def _pm_multi_sql() -> str:
    hashes = ", ".join(f"{q.h(0, 'pm', 'k', c)} AS h_{c}" for c in LINE_COLS)
    scaled = ", ".join(f"{q.minmax(c, f'lo_{c}', f'hi_{c}')} AS v_{c}" for c in LINE_COLS)
    draws = ", ".join(f"{q.u(f'h_{c}', 0)} AS a_{c}, {q.u(f'h_{c}', 1)} AS b_{c}" for c in LINE_COLS)

    def one(c):
        l, r = q.pm_core(f"v_{c}", 3.0, 3.0)
        noisy = q.pm(f"v_{c}", f"a_{c}", f"b_{c}", 3.0, 3.0)
        return f"round(CASE WHEN split = 'test' THEN {l} + ({r} - {l}) * a_{c} ELSE {noisy} END, 6) AS {c}"

    return f"""WITH s AS (SELECT *, {q.LINE_KEY} AS k FROM ({LINE_SPLIT})), f AS ({_line_fit(LINE_COLS)}),
      x AS (SELECT {q.LINE_IDS}, split, {hashes}, {scaled} FROM s, f), n AS (SELECT *, {draws} FROM x)
    SELECT {q.LINE_IDS}, split, {', '.join(one(c) for c in LINE_COLS)} FROM n"""


@query("pm_multi", _pm_multi_sql())
def pm_multi(spark, sf):
    """Four columns, train and test rows, in one pass."""
    lines = line_table(spark, sf)
    fitted = scale.fit(lines, LINE_COLS, where=is_train())
    out = privatise.perturb_pm(
        lines, LINE_COLS, fitted, piecewise.Piecewise(3.0, 3.0), line_key(), 0, test=F.col("split") == "test"
    )
    return out.select(*LINE_IDS, "split", *[F.round(c, 6).alias(c) for c in LINE_COLS])


@query(
    "pm_label_index",
    f"WITH {price_rows('TRUE', 'o_totalprice')} SELECT o_orderkey, split, "
    f"CASE WHEN split = 'test' THEN o_totalprice ELSE round({q.pm('v', 'u0', 'u1', 2.0, 3.0)}, 6) END AS label FROM n",
)
def pm_label_index(spark, sf):
    """Train labels as LDP outputs, test labels raw."""
    orders = order_table(spark, sf)
    fitted = scale.fit(orders, ["o_totalprice"], where=is_train())
    noisy = privatise.perturb_pm(
        orders.withColumn("raw", F.col("o_totalprice")), ["o_totalprice"], fitted, piecewise.Piecewise(2.0, 3.0), row_key("o_orderkey"), 0
    )
    label = F.when(is_train(), F.round("o_totalprice", 6)).otherwise(F.col("raw"))
    return noisy.select("o_orderkey", "split", label.alias("label"))


_A2 = q.pm_constants(2.0, 3.0)["a"]


@query(
    "pm_label_linear",
    f"""WITH {price_rows('TRUE', 'o_totalprice')}, y AS (SELECT *, {q.pm('v', 'u0', 'u1', 2.0, 3.0)} AS noisy FROM n)
    SELECT o_orderkey, split, CASE WHEN split = 'test' THEN o_totalprice
      ELSE round((noisy + {q.d(_A2)}) / {q.d(2 * _A2)} * (hi - lo) + lo, 4) END AS label FROM y""",
)
def pm_label_linear(spark, sf):
    orders = order_table(spark, sf)
    fitted = scale.fit(orders, ["o_totalprice"], where=is_train())
    pm = piecewise.Piecewise(2.0, 3.0)
    noisy = privatise.perturb_pm(
        orders.withColumn("raw", F.col("o_totalprice")), ["o_totalprice"], fitted, pm, row_key("o_orderkey"), 0
    )
    mapped = privatise.pm_label_to_range(F.col("o_totalprice"), pm.a, fitted["o_totalprice"])
    return noisy.select("o_orderkey", "split", F.when(is_train(), F.round(mapped, 4)).otherwise(F.col("raw")).alias("label"))


@query(
    "pm_missing_values",
    f"""WITH s AS (SELECT o_orderkey, {q.split(ORDER)} AS split, CASE WHEN {q.u(q.h(7, 'null', ORDER, 'price'))} >= 0.1e0 THEN o_totalprice END AS price FROM orders),
      f AS (SELECT min(price) AS lo, max(price) AS hi FROM s WHERE split = 'train'),
      n AS (SELECT o_orderkey, {q.minmax('price', 'lo', 'hi')} AS v, {noise_columns(0, 'pm', ORDER, 'price')} FROM s, f),
      y AS (SELECT o_orderkey, v, u0, {q.pm('v', 'u0', 'u1', 1.0, 3.0)} AS noisy FROM n)
    SELECT o_orderkey, round(noisy, 6) AS kept, CASE WHEN v IS NOT NULL THEN round(noisy, 6)
      WHEN u0 < {q.d(q.pm_constants(1.0, 3.0)['p'])} THEN NULL ELSE 0.0e0 END AS filled FROM y""",
)
def pm_missing_values(spark, sf):
    """Both NULL policies side by side (NaN shown as NULL)."""
    orders = order_table(spark, sf)
    gaps = orders.withColumn("price", F.when(uniform(7, "null", row_key("o_orderkey"), "price") >= 0.1, F.col("o_totalprice")))
    s = scale.fit(gaps, ["price"], where=is_train())["price"]
    v, params, key = privatise.scaled("price", s), piecewise.Piecewise(1.0, 3.0).columns(), row_key("o_orderkey")
    out = project(
        gaps,
        [
            piecewise.perturb("kept", v, params, key, 0, "price"),
            piecewise.perturb("filled", v, params, key, 0, "price", null_policy="zero_or_nan"),
        ],
    )
    filled = F.round(F.nanvl("filled", F.lit(None).cast("double")), 6)
    return out.select("o_orderkey", F.round("kept", 6).alias("kept"), filled.alias("filled"))


# ---------------------------------------------------------------- randomised response

# probability to keep the category, of 5 at budget 1
_KEEP5 = "exp(1.0e0) / (exp(1.0e0) + 4)"
EVENT_CODES = f"""c AS (SELECT event_type AS v, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)),
      n AS (SELECT event_id, event_type, code, {noise_columns(0, 'de', EVENT, 'event_type')} FROM events JOIN c ON event_type = v)"""


def _events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return events, encode.categories(events, "event_type")


@query(
    "de_reference",
    f"""WITH {EVENT_CODES}
    SELECT event_id, event_type, c.v AS noisy FROM n JOIN c
      ON c.code = CASE WHEN u0 > {_KEEP5} THEN CAST(floor(u1 * 5) AS BIGINT) ELSE n.code END""",
)
def de_reference(spark, sf):
    events, cats = _events(spark, sf)
    return privatise.respond(events, "event_type", cats, 1.0, row_key("event_id"), 0, mode="all", output="noisy")


@query(
    "de_strict",
    f"""WITH {EVENT_CODES}
    SELECT event_id, event_type, c.v AS noisy FROM n JOIN c
      ON c.code = CASE WHEN u0 > {_KEEP5} THEN (n.code + 1 + CAST(floor(u1 * 4) AS BIGINT)) % 5 ELSE n.code END""",
)
def de_strict(spark, sf):
    events, cats = _events(spark, sf)
    return privatise.respond(events, "event_type", cats, 1.0, row_key("event_id"), 0, output="noisy")


@query(
    "de_nullable",
    f"""WITH n AS (SELECT c_custkey, CASE WHEN {q.u(q.h(7, 'null', q.text('c_custkey'), 'code'))} >= 0.2e0 THEN c_nationkey END AS code,
        {noise_columns(0, 'de', q.text('c_custkey'), 'code')} FROM customer)
    SELECT c_custkey, code, CASE WHEN code IS NULL THEN NULL WHEN u0 > exp(2.0e0) / (exp(2.0e0) + 24)
      THEN CAST(floor(u1 * 25) AS INTEGER) ELSE code END AS noisy FROM n""",
)
def de_nullable(spark, sf):
    """Integer codes; NULL passes through."""
    key = row_key("c_custkey")
    code = F.when(uniform(7, "null", key, "code") >= 0.2, F.col("c_nationkey"))
    customers = table(spark, sf, "customer").select("c_custkey", code.alias("code"))
    p = response.keep_probability(2.0, 25)
    return project(customers, [response.respond_index("noisy", F.col("code"), 25, p, key, 0, "code", mode="all")])


_KEEP_SQL = ", ".join(
    f"({q.d(e)}, {q.d(math.exp(e))})" for e in (1.0, 3.0, 5.0)
)


@query(
    "de_keep_rates",
    f"""WITH k AS (SELECT count(DISTINCT p_brand) AS k, count(*) AS n FROM part), e(eps, e) AS (VALUES {_KEEP_SQL})
    SELECT eps, CAST(k AS INTEGER) AS k, n AS n_rows, round(e / (e + k - 1), 9) AS p_keep,
      round(ln(1.0e0 + k * e / (k - 1)), 9) AS effective_eps FROM k, e""",
)
def de_keep_rates(spark, sf):
    """What the redraw-from-all form really spends on a column of the table."""
    counted = table(spark, sf, "part").agg(
        F.count_distinct("p_brand").cast("int").alias("k"), F.count(F.lit(1)).alias("n_rows")
    )
    budgets = F.array(*[F.lit(e) for e in (1.0, 3.0, 5.0)])
    eps, k = F.col("eps"), F.col("k")
    return counted.withColumn("eps", F.explode(budgets)).select(
        "eps",
        "k",
        "n_rows",
        F.round(response.keep_probability_column(eps, k), 9).alias("p_keep"),
        F.round(response.effective_epsilon_column(eps, k), 9).alias("effective_eps"),
    )


# ---------------------------------------------------------------- quantised mechanism

# design at eps = 3, N = 7: window width 2 for both objectives
EPS, N, WIDTH = 3.0, 7, 2
QM_COLS = ("l_quantity", "l_extendedprice", "l_tax")


def feature_mechanism(spark, eps=EPS, n=N, obj="avg"):
    return design_mechanisms(spark, [(obj, eps, n)])[(obj, eps, n)]


def qm_rows(cols, where: str = "TRUE") -> str:
    """CTEs s, f, r(ids, k, col, v, u): one row per line and column."""
    parts = " UNION ALL ".join(
        f"SELECT {q.LINE_IDS}, split, k, '{c}' AS col, {q.minmax(c, f'lo_{c}', f'hi_{c}')} AS v, {q.u(q.h(0, 'qm', 'k', c))} AS u FROM s, f WHERE {where}"
        for c in cols
    )
    return f"s AS (SELECT *, {q.LINE_KEY} AS k FROM ({LINE_SPLIT})), f AS ({_line_fit(cols)}), r AS ({parts})"


def _pivot(cols, value: str, source: str) -> str:
    picks = ", ".join(f"max(CASE WHEN col = '{c}' THEN {value} END) AS {c}" for c in cols)
    return f"SELECT {q.LINE_IDS}, {picks} FROM {source} GROUP BY {q.LINE_IDS}, k"


@query(
    "qm_prob",
    f"""WITH {q.qm_tables(EPS, N, WIDTH)}, s AS ({ORDER_SPLIT}), {PRICE_FIT},
      r AS (SELECT o_orderkey, {q.minmax('o_totalprice', 'lo', 'hi')} AS v, 0.0e0 AS u FROM s, f),
      p AS ({q.qm_probability('r', 'o_orderkey', N)})
    SELECT o_orderkey, {', '.join(f'round(max(CASE WHEN pos = {k} THEN p END), 9) AS p{k}' for k in range(N))} FROM p GROUP BY o_orderkey""",
)
def qm_prob(spark, sf):
    orders = order_table(spark, sf)
    s = scale.fit(orders, ["o_totalprice"], where=is_train())["o_totalprice"]
    lookup = quantised.Lookup([feature_mechanism(spark)])
    out = project(orders, [quantised.probabilities("p", privatise.scaled("o_totalprice", s), lookup)])
    return out.select("o_orderkey", *[F.round(f"p.p{k}", 9).alias(f"p{k}") for k in range(N)])


@query(
    "qm_sample",
    f"""WITH {q.qm_tables(EPS, N, WIDTH)}, {qm_rows(QM_COLS)}, x AS ({q.qm_sample('r', q.LINE_IDS + ', k, col', N)})
    {_pivot(QM_COLS, 'idx', 'x')}""",
)
def qm_sample(spark, sf):
    lines = line_table(spark, sf)
    fitted = scale.fit(lines, QM_COLS, where=is_train())
    out = privatise.perturb_qm(lines, QM_COLS, fitted, quantised.Lookup([feature_mechanism(spark)]), line_key(), 0)
    return out.select(*LINE_IDS, *QM_COLS)


# the best average-case mechanism at eps 1 with 64 outputs has a window of 27
WIDE_N, WIDE_WIDTH = 64, 27


def wide_lookup(spark):
    return quantised.Lookup([feature_mechanism(spark, 1.0, WIDE_N)])


def _wide_rows(where: str) -> str:
    return f"""{q.qm_tables(1.0, WIDE_N, WIDE_WIDTH)}, s AS ({ORDER_SPLIT}), {PRICE_FIT},
      r AS (SELECT o_orderkey, {q.minmax('o_totalprice', 'lo', 'hi')} AS v, 0.0e0 AS u FROM s, f WHERE {where}),
      p AS ({q.qm_probability('r', 'o_orderkey', WIDE_N)})"""


@query(
    "qm_wide_prob",
    f"""WITH {_wide_rows("TRUE")} SELECT o_orderkey, {', '.join(f'round(max(CASE WHEN pos = {k} THEN p END), 9) AS p{k}' for k in range(WIDE_N))} FROM p GROUP BY o_orderkey""",
)
def qm_wide_prob(spark, sf):
    """Probabilities of 64 outputs."""
    orders = order_table(spark, sf)
    s = scale.fit(orders, ["o_totalprice"], where=is_train())["o_totalprice"]
    out = project(orders, [quantised.probabilities("p", privatise.scaled("o_totalprice", s), wide_lookup(spark))])
    return out.select("o_orderkey", *[F.round(f"p.p{k}", 9).alias(f"p{k}") for k in range(WIDE_N)])


@query(
    "qm_wide_argmax",
    f"""WITH {_wide_rows("split = 'test'")}, b AS (SELECT *, max(p) OVER (PARTITION BY o_orderkey) AS best FROM p),
      m AS (SELECT o_orderkey, min(pos) AS pos FROM b WHERE p = best GROUP BY o_orderkey)
    SELECT o_orderkey, CAST(CASE WHEN pos < {WIDE_N // 2} THEN pos - {WIDE_N // 2} ELSE pos - {WIDE_N // 2} + 1 END AS INTEGER) AS o_totalprice FROM m""",
)
def qm_wide_argmax(spark, sf):
    """The most probable of 64 outputs: one search over the corners of the upper envelope."""
    orders = order_table(spark, sf)
    s = scale.fit(orders, ["o_totalprice"], where=is_train())["o_totalprice"]
    test = orders.where(~is_train())
    out = project(test, [quantised.most_probable("idx", privatise.scaled("o_totalprice", s), wide_lookup(spark))])
    return out.select("o_orderkey", F.col("idx").alias("o_totalprice"))


@query(
    "qm_argmax",
    f"""WITH {q.qm_tables(EPS, N, WIDTH)}, {qm_rows(QM_COLS, "split = 'test'")},
      p AS ({q.qm_probability('r', q.LINE_IDS + ', k, col', N)}),
      b AS (SELECT *, max(p) OVER (PARTITION BY {q.LINE_IDS}, k, col) AS best FROM p),
      x AS (SELECT {q.LINE_IDS}, k, col, CAST(min(pos) - {N // 2} AS INTEGER) AS idx FROM b WHERE p = best GROUP BY {q.LINE_IDS}, k, col)
    {_pivot(QM_COLS, 'idx', 'x')}""",
)
def qm_argmax(spark, sf):
    lines = line_table(spark, sf)
    fitted = scale.fit(lines, QM_COLS, where=is_train())
    lookup = quantised.Lookup([feature_mechanism(spark)])
    test = lines.where(~is_train())
    out = project(test, [quantised.most_probable(c, privatise.scaled(c, fitted[c]), lookup) for c in QM_COLS])
    return out.select(*LINE_IDS, *QM_COLS)


_A1 = q.window_matrix(EPS, N, WIDTH)[1]


@query(
    "qm_value",
    f"""WITH {q.qm_tables(EPS, N, WIDTH)}, {qm_rows(('l_quantity',))}, x AS ({q.qm_sample('r', q.LINE_IDS + ', k, v', N)})
    SELECT {q.LINE_IDS}, round(v, 9) AS v, idx, round(idx * {q.d(_A1)}, 9) AS a FROM x""",
)
def qm_value(spark, sf):
    lines = line_table(spark, sf)
    s = scale.fit(lines, ["l_quantity"], where=is_train())["l_quantity"]
    m = feature_mechanism(spark)
    v = privatise.scaled("l_quantity", s)
    out = project(lines, [quantised.sample("idx", v, quantised.Lookup([m]), line_key(), 0, "l_quantity")])
    return out.select(
        *LINE_IDS, F.round(v, 9).alias("v"), "idx", F.round(quantised.index_value(F.col("idx"), m.a1), 9).alias("a")
    )


def _qm_label_sql(label: str) -> str:
    # label mechanism: eps = 1, N = 6, window width 3
    return f"""WITH {q.qm_tables(1.0, 6, 3)}, s AS ({ORDER_SPLIT}), {PRICE_FIT},
      r AS (SELECT o_orderkey, split, o_totalprice, lo, hi, {q.minmax('o_totalprice', 'lo', 'hi')} AS v, {q.u(q.h(0, 'qm', ORDER, 'o_totalprice'))} AS u FROM s, f),
      x AS ({q.qm_sample('r', 'o_orderkey, split, o_totalprice, lo, hi', 6)})
    SELECT o_orderkey, split, CASE WHEN split = 'test' THEN o_totalprice ELSE {label} END AS label FROM x"""


def _qm_label(spark, sf):
    orders = order_table(spark, sf)
    fitted = scale.fit(orders, ["o_totalprice"], where=is_train())
    m = feature_mechanism(spark, 1.0, 6)
    noisy = privatise.perturb_qm(
        orders.withColumn("raw", F.col("o_totalprice")), ["o_totalprice"], fitted, quantised.Lookup([m]), row_key("o_orderkey"), 0
    )
    return noisy, m, fitted["o_totalprice"]


@query("qm_label_index", _qm_label_sql("CAST(idx AS DOUBLE)"))
def qm_label_index(spark, sf):
    noisy, _, _ = _qm_label(spark, sf)
    return noisy.select(
        "o_orderkey", "split", F.when(is_train(), F.col("o_totalprice").cast("double")).otherwise(F.col("raw")).alias("label")
    )


@query("qm_label_linear", _qm_label_sql("round((idx + 3) / 6.0e0 * (hi - lo) + lo, 4)"))
def qm_label_linear(spark, sf):
    noisy, m, s = _qm_label(spark, sf)
    mapped = F.round(privatise.qm_label_to_range(F.col("o_totalprice"), *m.index_range, s), 4)
    return noisy.select("o_orderkey", "split", F.when(is_train(), mapped).otherwise(F.col("raw")).alias("label"))


@query(
    "label_peek",
    f"""WITH {price_rows('TRUE', 'o_totalprice')}
    SELECT o_orderkey, o_totalprice AS before, round({q.pm('v', 'u0', 'u1', 2.0, 3.0)}, 6) AS after FROM n
    WHERE split = 'train' ORDER BY o_orderkey LIMIT 5""",
)
def label_peek(spark, sf):
    orders = order_table(spark, sf).where(is_train())
    fitted = scale.fit(orders, ["o_totalprice"])
    noisy = privatise.perturb_pm(orders, ["o_totalprice"], fitted, piecewise.Piecewise(2.0, 3.0), row_key("o_orderkey"), 0)
    out = profile.before_after(orders, noisy, "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", "before", F.round("after", 6).alias("after"))


# every customer names a budget: 12 resolutions, epsilon in steps of 1/4
BUDGET_EPS = "1.0e0 + (c_custkey % 16) / 4.0e0"
BUDGET_N = "2 + c_nationkey % 12"


def _by_budget_sql() -> str:
    from .mechanism_queries import design_ctes

    budgets = f"SELECT DISTINCT {BUDGET_EPS} AS eps, CAST({BUDGET_N} AS INTEGER) AS n_outputs FROM customer"
    return f"""WITH {design_ctes(budgets)},
      cell AS (SELECT eps, n_outputs, i, j, p, i * a1 AS a FROM picked_cells WHERE obj = 'avg'),
      knot AS (SELECT eps, n_outputs, j, sum(a * p) AS x FROM cell GROUP BY eps, n_outputs, j),
      seg AS (SELECT r.eps, r.n_outputs, r.j, l.x AS x_left, r.x AS x_right FROM knot r JOIN knot l
        ON l.eps = r.eps AND l.n_outputs = r.n_outputs AND l.j = r.j - 1),
      ends AS (SELECT eps, n_outputs, min(x) AS x_min, max(x) AS x_max, max(j) AS j_max FROM knot GROUP BY eps, n_outputs),
      f AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
      r AS (SELECT c_custkey, {BUDGET_EPS} AS eps, {BUDGET_N} AS n_outputs, {q.minmax('c_acctbal', 'lo', 'hi')} AS v,
        {q.u(q.h(0, 'qm', q.text('c_custkey'), 'c_acctbal'))} AS u FROM customer, f),
      g AS (SELECT r.*, s.j, s.x_left, s.x_right, least(greatest(abs(v), x_min), x_max) AS m FROM r
        JOIN ends e ON e.eps = r.eps AND e.n_outputs = r.n_outputs
        JOIN seg s ON s.eps = r.eps AND s.n_outputs = r.n_outputs
          AND (abs(v) > s.x_left OR s.j = 1) AND (abs(v) <= s.x_right OR s.j = e.j_max)),
      p AS (SELECT g.c_custkey, g.eps, g.n_outputs, u, CASE WHEN v < 0 THEN -b.i ELSE b.i END AS i,
        (b.p - a.p) / (x_right - x_left) * (m - x_right) + b.p AS p
        FROM g JOIN cell b ON b.eps = g.eps AND b.n_outputs = g.n_outputs AND b.j = g.j
        JOIN cell a ON a.eps = g.eps AND a.n_outputs = g.n_outputs AND a.j = g.j - 1 AND a.i = b.i),
      w AS (SELECT *, sum(p) OVER (PARTITION BY c_custkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum,
        row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS n FROM p),
      z AS (SELECT c_custkey, eps, n_outputs, sum(CASE WHEN n < n_outputs AND u >= cum THEN 1 ELSE 0 END) + 1 AS n FROM w
        GROUP BY c_custkey, eps, n_outputs)
    SELECT z.c_custkey, z.eps, CAST(z.n_outputs AS INTEGER) AS n_outputs, CAST(w.i AS INTEGER) AS noisy
    FROM z JOIN w ON w.c_custkey = z.c_custkey AND w.n = z.n"""


def customer_budgets(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_acctbal",
        (F.lit(1.0) + (F.col("c_custkey") % 16) / 4.0).alias("eps"),
        (F.lit(2) + F.col("c_nationkey") % 12).cast("int").alias("n_outputs"),
    )


@query("qm_by_budget", _by_budget_sql())
def qm_by_budget(spark, sf):
    """Every row names its own mechanism: range join against the designed segments."""
    customers = customer_budgets(spark, sf)
    cells = mechanism.design(mechanism.distinct_budgets(customers), ["avg"]).drop("obj", "width", "a1")
    segments = privatise.segments(cells, mechanism.KEYS)
    s = scale.fit(customers, ["c_acctbal"])["c_acctbal"]
    out = privatise.sample_by_budget(
        customers, privatise.scaled("c_acctbal", s), segments, mechanism.KEYS, row_key("c_custkey"), 0, "c_acctbal", "noisy"
    )
    return out.select("c_custkey", "eps", "n_outputs", "noisy")
