"""Mechanism tables for the budgets that the customers name. The number of budgets grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ldpspark.operators import mechanism as mech
from ldpspark.session import scratch_path
from ldpspark.sources import catalog

from .registry import query, table

# one budget per customer: epsilon from the balance (to 4 decimals), 2 to 13 outputs from the nation
BUDGET_SQL = """SELECT DISTINCT round((c_acctbal + 1000.0e0) / 2500.0e0 + 0.5e0, 4) AS eps,
      CAST(2 + c_nationkey % 12 AS INTEGER) AS n_outputs FROM customer"""


def budgets(spark, sf):
    customers = table(spark, sf, "customer")
    return mech.distinct_budgets(
        customers.select(
            ((F.col("c_acctbal") + 1000.0) / 2500.0 + 0.5).alias("eps"),
            (F.lit(2) + F.col("c_nationkey") % 12).alias("n_outputs"),
        )
    )


SIGNED = """CASE WHEN n_outputs % 2 = 1 OR pos < n_outputs // 2 THEN pos - n_outputs // 2 ELSE pos - n_outputs // 2 + 1 END"""


def design_ctes(budget_sql: str) -> str:
    """cand(…, width), cells(… i, j, p), mom, score, pick(obj, …), picked_cells(obj, …, a1, i, j, p)."""
    return f"""bud AS ({budget_sql}),
      cand AS (SELECT eps, n_outputs, CAST(w.c AS INTEGER) AS width FROM bud, LATERAL (SELECT unnest(generate_series(1, n_outputs - 1)) AS c) w),
      kn AS (SELECT *, n_outputs - width AS free, exp(eps) AS e FROM cand),
      kj AS (SELECT kn.*, CAST(t.j AS INTEGER) AS j FROM kn, LATERAL (SELECT unnest(generate_series(0, (free + 1) // 2)) AS j) t),
      kp AS (SELECT kj.*, CAST(t.pos AS INTEGER) AS pos FROM kj, LATERAL (SELECT unnest(generate_series(0, n_outputs - 1)) AS pos) t),
      cells AS (SELECT eps, n_outputs, width, {SIGNED} AS i, j,
        1.0e0 / (width * e + free) * (
          (CASE WHEN pos >= free // 2 + j AND pos < free // 2 + j + width THEN e ELSE 1.0e0 END)
          + (CASE WHEN pos >= free // 2 + j + (CASE WHEN free % 2 = 1 AND j = 0 THEN 1 ELSE 0 END)
              AND pos < free // 2 + j + (CASE WHEN free % 2 = 1 AND j = 0 THEN 1 ELSE 0 END) + width THEN e ELSE 1.0e0 END)) / 2.0e0 AS p
        FROM kp),
      mom0 AS (SELECT eps, n_outputs, width, j, sum(i * p) AS x, sum(i * i * p) AS e2 FROM cells GROUP BY eps, n_outputs, width, j),
      a1s AS (SELECT eps, n_outputs, width, 1.0e0 / max(x) AS a1 FROM mom0 GROUP BY eps, n_outputs, width),
      mom AS (SELECT m.eps, m.n_outputs, m.width, a1, j, x * a1 AS x, e2 * a1 * a1 AS e2 FROM mom0 m JOIN a1s a
        ON a.eps = m.eps AND a.n_outputs = m.n_outputs AND a.width = m.width),
      st AS (SELECT *, lag(x) OVER w AS xp, lag(e2) OVER w AS ep FROM mom WINDOW w AS (PARTITION BY eps, n_outputs, width ORDER BY j)),
      score AS (SELECT eps, n_outputs, width, min(a1) AS a1,
        sum(CASE WHEN abs(x - xp) > 1e-20 THEN (e2 + ep) / 2 * (x - xp) - (x * x * x - xp * xp * xp) / 3 ELSE 0 END) AS avg_var,
        max(greatest(e2 - x * x, CASE WHEN abs(x - xp) >= 1e-12 AND (e2 - ep) / (2 * (x - xp)) BETWEEN xp - 1e-9 AND x + 1e-9
          THEN (e2 - ep) / (x - xp) * ((e2 - ep) / (2 * (x - xp)) - x) + e2 - ((e2 - ep) / (2 * (x - xp))) * ((e2 - ep) / (2 * (x - xp))) END)) AS worst_var
        FROM st GROUP BY eps, n_outputs, width),
      pick AS (
        SELECT 'avg' AS obj, * FROM (SELECT *, row_number() OVER (PARTITION BY eps, n_outputs ORDER BY avg_var, width) AS rn FROM score) WHERE rn = 1
        UNION ALL
        SELECT 'worst' AS obj, * FROM (SELECT *, row_number() OVER (PARTITION BY eps, n_outputs ORDER BY worst_var, width) AS rn FROM score) WHERE rn = 1),
      picked_cells AS (SELECT obj, k.eps, k.n_outputs, k.width, a1, c.i, c.j, c.p FROM pick k JOIN cells c
        ON c.eps = k.eps AND c.n_outputs = k.n_outputs AND c.width = k.width)"""


DESIGN = design_ctes(BUDGET_SQL)
KEYED = "obj, eps, n_outputs"


def designed(spark, sf):
    return mech.design(budgets(spark, sf))


@query(
    "mech_sweep",
    f"WITH {DESIGN} SELECT obj, eps, n_outputs, width, round(a1, 8) AS a1, round(avg_var, 7) AS avg_var, round(worst_var, 7) AS worst_var FROM pick",
)
def mech_sweep(spark, sf):
    out = mech.sweep(budgets(spark, sf))
    return out.select(
        "obj", "eps", "n_outputs", "width", F.round("a1", 8).alias("a1"), F.round("avg_var", 7).alias("avg_var"), F.round("worst_var", 7).alias("worst_var")
    )


@query(
    "mech_grid",
    f"""WITH {DESIGN} SELECT obj, eps, n_outputs, CAST(i AS INTEGER) AS i, round(i * a1, 8) AS a FROM picked_cells WHERE j = 0""",
)
def mech_grid(spark, sf):
    out = mech.output_grid(mech.sweep(budgets(spark, sf)))
    return out.select("obj", "eps", "n_outputs", "i", F.round("a", 8).alias("a"))


@query(
    "mech_cells",
    f"""WITH {DESIGN} SELECT obj, eps, n_outputs, CAST(i AS INTEGER) AS i, j, round(i * a1, 8) AS a, round(p, 9) AS p FROM picked_cells""",
)
def mech_cells(spark, sf):
    return designed(spark, sf).select("obj", "eps", "n_outputs", "i", "j", F.round("a", 8).alias("a"), F.round("p", 9).alias("p"))


START_CTES = f"""bud AS ({BUDGET_SQL}),
      b AS (SELECT eps, n_outputs, n_outputs // 2 AS n, exp(eps) AS e, exp(eps / 3.0e0) AS t FROM bud),
      b2 AS (SELECT *, (e + 1) / ((e - 1) * n) AS a1s, n * ((e + 1) / ((e - 1) * n)) AS am, e / (e + t) AS pc, t / (e + t) AS pt FROM b),
      kj AS (SELECT b2.*, CAST(g.j AS INTEGER) AS j FROM b2, LATERAL (SELECT unnest(generate_series(0, n)) AS j) g),
      kx AS (SELECT *, (am + 1) / 2 * (CAST(j AS DOUBLE) / n) - (am - 1) / 2 AS l, (am + 1) / 2 * (CAST(j AS DOUBLE) / n) + (am - 1) / 2 AS r FROM kj),
      kp AS (SELECT kx.*, CAST(g.pos AS INTEGER) AS pos FROM kx, LATERAL (SELECT unnest(generate_series(0, n_outputs - 1)) AS pos) g),
      ki AS (SELECT *, {SIGNED} AS i FROM kp),
      kb AS (SELECT *, CASE WHEN i = -n THEN -am ELSE (i - 0.5e0) / n * am END AS lo, CASE WHEN i = n THEN am ELSE (i + 0.5e0) / n * am END AS hi FROM ki),
      kr AS (SELECT *, greatest(0, least(hi, l) - greatest(lo, -am)) * (CASE WHEN 2 * am - (r - l) > 1e-9 THEN pt / (2 * am - (r - l)) ELSE 0 END)
        + greatest(0, least(hi, r) - greatest(lo, l)) * (CASE WHEN r - l > 1e-9 THEN pc / (r - l) ELSE 0 END)
        + greatest(0, least(hi, am) - greatest(lo, r)) * (CASE WHEN 2 * am - (r - l) > 1e-9 THEN pt / (2 * am - (r - l)) ELSE 0 END) AS raw FROM kb),
      kn AS (SELECT *, CASE WHEN sum(raw) OVER w > 1e-9 THEN raw / sum(raw) OVER w ELSE raw END AS p0 FROM kr WINDOW w AS (PARTITION BY eps, n_outputs, j)),
      ka AS (SELECT *, a1s / sum(CASE WHEN j = n THEN i * a1s * p0 END) OVER (PARTITION BY eps, n_outputs) AS a1, 0.9e0 * p0 + 0.1e0 / n_outputs AS mix FROM kn),
      start_cells AS (SELECT eps, n_outputs, i, i * a1 AS a, j, mix / sum(mix) OVER (PARTITION BY eps, n_outputs, j) AS p FROM ka)"""


@query(
    "mech_initial",
    f"WITH {START_CTES} SELECT eps, n_outputs, CAST(i AS INTEGER) AS i, j, round(a, 7) AS a, round(p, 9) AS p FROM start_cells",
)
def mech_initial(spark, sf):
    out = mech.start_table(budgets(spark, sf))
    return out.select("eps", "n_outputs", "i", "j", F.round("a", 7).alias("a"), F.round("p", 9).alias("p"))


@query(
    "mech_moments",
    f"""WITH {START_CTES} SELECT eps, n_outputs, j, round(sum(a * p), 7) AS x, round(sum(a * a * p), 6) AS e2 FROM start_cells
    GROUP BY eps, n_outputs, j""",
)
def mech_moments(spark, sf):
    out = mech.knot_moments(mech.start_table(budgets(spark, sf)))
    return out.select("eps", "n_outputs", "j", F.round("x", 7).alias("x"), F.round("e2", 6).alias("e2"))


START_STEPS = f"""{START_CTES},
      mo AS (SELECT eps, n_outputs, j, sum(a * p) AS x, sum(a * a * p) AS e2 FROM start_cells GROUP BY eps, n_outputs, j),
      stp AS (SELECT *, lag(x) OVER w AS xp, lag(e2) OVER w AS ep FROM mo WINDOW w AS (PARTITION BY eps, n_outputs ORDER BY j))"""


@query(
    "mech_avg_var",
    f"""WITH {START_STEPS} SELECT eps, n_outputs, round(sum(CASE WHEN abs(x - xp) > 1e-20
      THEN (e2 + ep) / 2 * (x - xp) - (x * x * x - xp * xp * xp) / 3 ELSE 0 END), 6) AS avg_var FROM stp GROUP BY eps, n_outputs""",
)
def mech_avg_var(spark, sf):
    wanted = budgets(spark, sf)
    out = mech.average_variance(mech.start_table(wanted), n_cells=mech.most_cells(wanted))
    return out.select("eps", "n_outputs", F.round("avg_var", 6).alias("avg_var"))


@query(
    "mech_worst_var",
    f"""WITH {START_STEPS}, v AS (
      SELECT eps, n_outputs, e2 - x * x AS v FROM stp
      UNION ALL SELECT eps, n_outputs, (e2 - ep) / (x - xp) * ((e2 - ep) / (2 * (x - xp)) - x) + e2 - pow((e2 - ep) / (2 * (x - xp)), 2)
      FROM stp WHERE abs(x - xp) >= 1e-12 AND (e2 - ep) / (2 * (x - xp)) >= xp - 1e-9 AND (e2 - ep) / (2 * (x - xp)) <= x + 1e-9)
    SELECT eps, n_outputs, round(max(v), 6) AS worst_var FROM v GROUP BY eps, n_outputs""",
)
def mech_worst_var(spark, sf):
    wanted = budgets(spark, sf)
    out = mech.worst_variance(mech.start_table(wanted), n_cells=mech.most_cells(wanted))
    return out.select("eps", "n_outputs", F.round("worst_var", 6).alias("worst_var"))


# start tables are smoothed but not tuned, so some cells break the ratio bound
@query(
    "mech_violations",
    f"""WITH {START_CTES}, m AS (SELECT *, min(p) OVER (PARTITION BY eps, n_outputs, i) AS ps FROM start_cells)
    SELECT eps, n_outputs, CAST(i AS INTEGER) AS i, j, round(p, 8) AS p, round(ps, 8) AS p_star, round(exp(eps) * ps, 6) AS upper_bound
    FROM m WHERE p > exp(eps) * ps + 1e-9""",
)
def mech_violations(spark, sf):
    out = mech.ratio_violations(mech.start_table(budgets(spark, sf)))
    return out.select(
        "eps", "n_outputs", "i", "j", F.round("p", 8).alias("p"), F.round("p_star", 8).alias("p_star"), F.round("upper_bound", 6).alias("upper_bound")
    )


def _audit_sql(source: str) -> str:
    """Independent form: joins of a cell with its mirror cell instead of windows."""
    return f"""c AS ({source}),
      nk AS (SELECT {KEYED}, max(j) AS n FROM c GROUP BY {KEYED}),
      su AS (SELECT {KEYED}, sum(CASE WHEN abs(s - 1) > 1e-6 THEN 1 ELSE 0 END) AS bad FROM
        (SELECT {KEYED}, j, sum(p) AS s FROM c GROUP BY {KEYED}, j) GROUP BY {KEYED}),
      mn AS (SELECT {KEYED}, i, min(p) AS lo FROM c GROUP BY {KEYED}, i),
      ra AS (SELECT c.obj, c.eps, c.n_outputs, sum(CASE WHEN c.p > exp(c.eps) * mn.lo + 1e-9 THEN 1 ELSE 0 END) AS bad
        FROM c JOIN mn USING ({KEYED}, i) GROUP BY c.obj, c.eps, c.n_outputs),
      al AS (SELECT {KEYED}, i, j, p FROM c WHERE i >= 0 UNION ALL SELECT {KEYED}, -i, -j, p FROM c WHERE i <= 0),
      ba AS (SELECT {KEYED}, -c.i AS i, c.p AS b FROM c JOIN nk USING ({KEYED}) WHERE c.j = nk.n AND c.i <= 0),
      re AS (SELECT {KEYED}, sum(CASE WHEN p < b - 1e-9 OR p > exp(eps) * b + 1e-9 THEN 1 ELSE 0 END) AS bad FROM al JOIN ba USING ({KEYED}, i) GROUP BY {KEYED}),
      sy AS (SELECT {KEYED}, sum(CASE WHEN abs(l.p - r.p) > 1e-9 THEN 1 ELSE 0 END) AS bad FROM
        (SELECT {KEYED}, i, p FROM c WHERE j = 0 AND i > 0) l JOIN (SELECT {KEYED}, -i AS i, p FROM c WHERE j = 0 AND i < 0) r USING ({KEYED}, i) GROUP BY {KEYED}),
      xx AS (SELECT {KEYED}, j, sum(a * p) AS x FROM c GROUP BY {KEYED}, j),
      ga AS (SELECT {KEYED}, sum(CASE WHEN r.x - l.x < (CASE WHEN n_outputs % 2 = 1 THEN 0.0e0 ELSE 1e-7 END) - 1e-9 THEN 1 ELSE 0 END) AS bad
        FROM (SELECT {KEYED}, j, x FROM xx) r JOIN (SELECT {KEYED}, j + 1 AS j, x FROM xx) l USING ({KEYED}, j) GROUP BY {KEYED}),
      la AS (SELECT {KEYED}, x AS x_last FROM xx JOIN nk USING ({KEYED}) WHERE j = n),
      aa AS (SELECT {KEYED}, min(a) AS a1 FROM c WHERE i = 1 GROUP BY {KEYED})
    SELECT {KEYED}, CAST(su.bad AS BIGINT) AS sum_violations, CAST(ra.bad AS BIGINT) AS ratio_violations, CAST(re.bad AS BIGINT) AS reflected_violations,
      CAST(sy.bad AS BIGINT) AS symmetry_violations, CAST(ga.bad AS BIGINT) AS gap_violations, round(x_last, 6) AS x_last, round(a1, 7) AS a1,
      CAST(su.bad + ra.bad + re.bad + sy.bad + ga.bad = 0 AND abs(x_last - 1) <= 1e-6 AND a1 > 0 AS INTEGER) AS feasible
    FROM su JOIN ra USING ({KEYED}) JOIN re USING ({KEYED}) JOIN sy USING ({KEYED}) JOIN ga USING ({KEYED}) JOIN la USING ({KEYED}) JOIN aa USING ({KEYED})"""


@query(
    "mech_audit",
    f"WITH {DESIGN}, {START_CTES.replace('bud AS', 'bud_start AS').replace('FROM bud)', 'FROM bud_start)').replace('kn AS', 'kn_s AS').replace('FROM kn)', 'FROM kn_s)').replace('kj AS', 'kj_s AS').replace('FROM kj)', 'FROM kj_s)').replace('kp AS', 'kp_s AS').replace('FROM kp)', 'FROM kp_s)')}, "
    + _audit_sql(
        "SELECT obj, eps, n_outputs, i, i * a1 AS a, j, p FROM picked_cells UNION ALL SELECT 'start', eps, n_outputs, i, a, j, p FROM start_cells"
    ),
)
def mech_audit(spark, sf):
    """Designed mechanisms pass; untuned start tables do not."""
    keys = ["obj", *mech.KEYS]
    wanted = budgets(spark, sf)
    start = mech.start_table(wanted).withColumn("obj", F.lit("start"))
    cells = mech.design(wanted).select(*keys, "i", "a", "j", "p").unionByName(start.select(*keys, "i", "a", "j", "p"))
    # two designs and a start table a budget
    out = mech.audit(cells, keys, n_cells=mech.most_cells(wanted, 3))
    return out.select(
        *keys,
        "sum_violations",
        "ratio_violations",
        "reflected_violations",
        "symmetry_violations",
        "gap_violations",
        F.round("x_last", 6).alias("x_last"),
        F.round("a1", 7).alias("a1"),
        F.col("feasible").cast("int").alias("feasible"),
    )


@query(
    "mech_clean",
    f"""WITH {DESIGN}, c AS (SELECT eps, n_outputs, i, i * a1 AS a, n - j AS j, p FROM picked_cells
        JOIN (SELECT eps AS e2, n_outputs AS n2, max(j) AS n FROM picked_cells WHERE obj = 'avg' GROUP BY eps, n_outputs) m
        ON m.e2 = eps AND m.n2 = n_outputs WHERE obj = 'avg'),
      x AS (SELECT eps, n_outputs, j, sum(a * p) AS x FROM c GROUP BY eps, n_outputs, j),
      o AS (SELECT eps, n_outputs, j, row_number() OVER (PARTITION BY eps, n_outputs ORDER BY x) - 1 AS k FROM x)
    SELECT c.eps, c.n_outputs, CAST(c.i AS INTEGER) AS i, CAST(o.k AS INTEGER) AS j, round(c.p, 9) AS p
    FROM c JOIN o ON o.eps = c.eps AND o.n_outputs = c.n_outputs AND o.j = c.j""",
)
def mech_clean(spark, sf):
    """Knots stored in descending order are put right on load."""
    wanted = budgets(spark, sf)
    cells = mech.design(wanted, ["avg"])
    last = cells.groupBy(*mech.KEYS).agg(F.max("j").alias("last"))
    # a map of the last knots: cells are not sorted
    backwards = cells.join(last.hint("shuffle_hash"), list(mech.KEYS)).withColumn("j", F.col("last") - F.col("j"))
    out = mech.clean_knots(backwards.select(*mech.KEYS, "i", "a", "j", "p"), n_cells=mech.most_cells(wanted))
    return out.select(*mech.KEYS, "i", "j", F.round("p", 9).alias("p"))


@query(
    "mech_report",
    f"""WITH {DESIGN}, c AS (SELECT obj, eps, n_outputs, i, i * a1 AS a, j, p, max(j) OVER (PARTITION BY {KEYED}) AS n,
        sum(i * a1 * p) OVER (PARTITION BY {KEYED}, j) AS x FROM picked_cells)
    SELECT obj, eps, n_outputs, CAST(i AS INTEGER) AS i, round(a, 8) AS a, j, round(p, 9) AS p, round(x, 8) + 0 AS x FROM c
    WHERE p > 1e-4 AND j IN (0, n // 2, n)""",
)
def mech_report(spark, sf):
    wanted = budgets(spark, sf)
    cells = mech.design(wanted).select("obj", *mech.KEYS, "i", "a", "j", "p")
    out = mech.report(cells, ["obj", *mech.KEYS], n_cells=mech.most_cells(wanted, 2))
    return out.select(
        "obj", *mech.KEYS, "i", F.round("a", 8).alias("a"), "j", F.round("p", 9).alias("p"), (F.round("x", 8) + 0).alias("x")
    )


@query(
    "mech_get_or_create",
    f"""WITH {DESIGN} SELECT obj, eps, n_outputs, count(*) AS cells, round(sum(p), 6) AS p_total, round(max(i * a1), 7) AS a_max
    FROM picked_cells WHERE obj = 'avg' GROUP BY obj, eps, n_outputs""",
)
def mech_get_or_create(spark, sf):
    """Half of the keys are in the catalog already; the rest is designed, appended and read back."""
    path = scratch_path(spark, "mechanisms")
    wanted = budgets(spark, sf).withColumn("obj", F.lit("avg"))
    catalog.get_or_create(wanted.where(F.col("n_outputs") <= 7), path)
    cells = catalog.get_or_create(wanted, path)
    return cells.groupBy("obj", *mech.KEYS).agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("p"), 6).alias("p_total"), F.round(F.max("a"), 7).alias("a_max")
    )
