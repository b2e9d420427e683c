"""Profiling, splitting, scaling, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ldpspark.functions.rand import digest, draw, row_key, uniform
from ldpspark.operators import encode, lookup, profile, scale, split
from ldpspark.plans.config import Dataset
from ldpspark.plans.privatise import model_features, prepare_and_fit

from . import sqltext as q
from .registry import query, table, wide_table

EVENT = q.text("event_id")
ORDER = q.text("o_orderkey")
PART = q.text("p_partkey")


def line_key():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    return row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, day)


LINE_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_IDS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def with_gaps(df, key, rates: dict[str, float], source: str = "value"):
    """Copies of a column with NULLs at keyed random places."""
    return df.withColumns(
        {name: F.when(uniform(7, "null", key, name) >= rate, F.col(source)) for name, rate in rates.items()}
    )


def gaps_sql(rates: dict[str, float], key: str, source: str = "value") -> str:
    return ", ".join(
        f"CASE WHEN {q.u(q.h(7, 'null', key, name))} >= {q.d(rate)} THEN {source} END AS {name}" for name, rate in rates.items()
    )


GAPS = {"value_a": 0.3, "value_b": 0.45, "value_c": 0.6}
GAP_EVENTS = f"SELECT event_id, user_id, {gaps_sql(GAPS, EVENT)} FROM events"


def gap_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return with_gaps(events, row_key("event_id"), GAPS).drop("value")


@query(
    "missing_ratio",
    f"""WITH e AS ({GAP_EVENTS}), r AS (
      SELECT 'user_id' AS "column", avg(CASE WHEN user_id IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS ratio FROM e
      UNION ALL SELECT 'value_a', avg(CASE WHEN value_a IS NULL THEN 1.0e0 ELSE 0.0e0 END) FROM e
      UNION ALL SELECT 'value_b', avg(CASE WHEN value_b IS NULL THEN 1.0e0 ELSE 0.0e0 END) FROM e
      UNION ALL SELECT 'value_c', avg(CASE WHEN value_c IS NULL THEN 1.0e0 ELSE 0.0e0 END) FROM e)
    SELECT "column", round(ratio, 9) AS ratio, CAST(ratio > 0.5e0 AS INTEGER) AS drop_transform,
      CAST(ratio > 0.4e0 AS INTEGER) AS drop_model FROM r""",
)
def missing_ratio(spark, sf):
    ratios = profile.missing_ratio(gap_events(spark, sf), ["user_id", *GAPS])
    return ratios.select(
        "column",
        F.round("ratio", 9).alias("ratio"),
        (F.col("ratio") > profile.TRANSFORM_THRESHOLD).cast("int").alias("drop_transform"),
        (F.col("ratio") > profile.MODEL_THRESHOLD).cast("int").alias("drop_model"),
    )


@query(
    "drop_sparse",
    f"SELECT event_id, user_id, value_a, value_b FROM ({GAP_EVENTS})",
)
def drop_sparse(spark, sf):
    return profile.drop_sparse(gap_events(spark, sf), exempt=["event_id"])


@query(
    "usable_features",
    f"""WITH e AS ({GAP_EVENTS}), r AS (
      SELECT CASE WHEN avg(CASE WHEN user_id IS NULL THEN 1.0e0 ELSE 0.0e0 END) > 0.4e0 THEN 0 ELSE 1 END
           + CASE WHEN avg(CASE WHEN value_b IS NULL THEN 1.0e0 ELSE 0.0e0 END) > 0.4e0 THEN 0 ELSE 1 END
           + CASE WHEN avg(CASE WHEN value_c IS NULL THEN 1.0e0 ELSE 0.0e0 END) > 0.4e0 THEN 0 ELSE 1 END AS n FROM e)
    SELECT CAST(n AS INTEGER) AS n_features, (SELECT count(*) FROM e) AS n_rows FROM r""",
)
def usable_features(spark, sf):
    events = gap_events(spark, sf)
    names = profile.usable_features(events, "value_a", ["event_id"])
    return events.agg(F.lit(len(names)).alias("n_features"), F.count(F.lit(1)).alias("n_rows"))


PROFILE_SET = Dataset("events", ("event_id",), "value_a")
PROFILED = ("user_id", "value_b", "value_c")


def _profile_sql() -> str:
    train = f"CASE WHEN {q.split(EVENT)} = 'train' THEN"
    parts = [
        f"""SELECT '{c}' AS "column", avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS missing,
          min({train} {c} END) AS lo, max({train} {c} END) AS hi, {int(c != "value_a")} AS tested FROM e"""
        for c in (*PROFILED, PROFILE_SET.label)
    ]
    return f"""WITH e AS ({GAP_EVENTS}), r AS ({" UNION ALL ".join(parts)})
    SELECT "column", CASE WHEN tested = 1 THEN round(missing, 9) END AS missing,
      CASE WHEN tested = 0 OR missing <= 0.5e0 THEN round(CAST(lo AS DOUBLE), 6) END AS train_min,
      CASE WHEN tested = 0 OR missing <= 0.5e0 THEN round(CAST(hi AS DOUBLE), 6) END AS train_max,
      CAST(tested = 1 AND missing <= 0.4e0 AS INTEGER) AS model_feature FROM r"""


@query("profile_and_fit", _profile_sql())
def profile_and_fit(spark, sf):
    """Missing shares, kept columns, train ranges and model features of a table from one aggregate over it."""
    prepared, fitted = prepare_and_fit(gap_events(spark, sf), PROFILE_SET)
    features = model_features(prepared, fitted)
    rows = []
    for c in (*PROFILED, PROFILE_SET.label):
        s = fitted.stats.get(c, scale.Stats())
        rows.append((c, fitted.missing.get(c), s.min, s.max, int(c in features)))
    out = spark.createDataFrame(rows, "`column` string, missing double, train_min double, train_max double, model_feature int")
    return out.select("column", *[F.round(c, d).alias(c) for c, d in (("missing", 9), ("train_min", 6), ("train_max", 6))], "model_feature")


@query("numeric_projection", "SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_projection(spark, sf):
    return profile.numeric_projection(table(spark, sf, "part"))


@query(
    "log_label",
    """WITH o AS (SELECT o_orderkey, o_totalprice - 250000.0e0 AS y FROM orders)
    SELECT o_orderkey, CASE WHEN y > -1 THEN round(ln(1.0e0 + y), 8) END AS y_log,
      CASE WHEN y > -1 THEN round(y, 3) END AS y_back FROM o""",
)
def log_label(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") - 250000.0).alias("y"))
    logged = profile.log_label(orders, "y")
    return logged.select(
        "o_orderkey", F.round("y", 8).alias("y_log"), F.round(profile.exp_label(F.col("y")), 3).alias("y_back")
    )


@query("uniform_keyed", f"""WITH k AS (SELECT {q.LINE_IDS}, {q.h(3, 'demo', q.LINE_KEY, 'l_quantity')} AS hx FROM lineitem)
    SELECT {q.LINE_IDS}, {q.u('hx', 0)} AS u0, {q.u('hx', 1)} AS u1 FROM k""")
def uniform_keyed(spark, sf):
    lines = wide_table(spark, sf, "lineitem")
    hashed = lines.select(*LINE_IDS, digest(3, "demo", line_key(), "l_quantity").alias("h"))
    return hashed.select(*LINE_IDS, draw(F.col("h"), 0).alias("u0"), draw(F.col("h"), 1).alias("u1"))


@query("hash_split", f"SELECT o_orderkey, {q.split(ORDER)} AS split FROM orders")
def hash_split(spark, sf):
    return split.hash_split(table(spark, sf, "orders").select("o_orderkey"), row_key("o_orderkey"))


@query(
    "exact_split",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {q.h(42, 'split', ORDER)}) AS n, count(*) OVER () AS rows_all
      FROM orders)
    SELECT o_orderkey, CASE WHEN n <= ceil(0.2e0 * rows_all) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def exact_split(spark, sf):
    return split.exact_split(table(spark, sf, "orders").select("o_orderkey"), row_key("o_orderkey"))


@query(
    "batch_assign",
    f"""WITH e AS (SELECT o_orderkey, epoch, md5(concat_ws('|', '', '5', 'epoch' || CAST(epoch AS VARCHAR), {ORDER}, '')) AS hx
        FROM orders, (VALUES (0), (1)) AS ep(epoch)),
      r AS (SELECT o_orderkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY hx) - 1 AS n,
        count(*) OVER (PARTITION BY epoch) AS rows_all FROM e)
    SELECT o_orderkey, epoch, CAST(n // 64 AS BIGINT) AS batch_id FROM r WHERE n // 64 < rows_all // 64""",
)
def batch_assign(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return split.assign_batches(orders, row_key("o_orderkey"), 64, epochs=2, seed=5)


def permuted_sql(source: str, size: int | str, seed: int, epochs: int) -> str:
    """CTEs ending in permuted(id, epoch, batch_id) for a relation of (id, text key): the rounds one by one."""
    turns = ", ".join(f"({e})" for e in range(epochs))
    keys = ", ".join(
        f"CAST('0x' || substr(md5('|{seed}|permute' || CAST(epoch AS VARCHAR) || '|{k}|'), {at}, 7) AS BIGINT) AS {name}{k}"
        for k in range(6)
        for name, at in (("m", 1), ("c", 8))
    )
    steps = [
        f"""ranks AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '', '', 'rank', key, ''))) - 1 AS x, count(*) OVER () AS n FROM ({source}))""",
        "sized AS (SELECT *, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS w FROM ranks)",
        f"""turn_0 AS (SELECT s.*, epoch, (n + w - 1) // w AS high, n - ((n + w - 1) // w - 1) * w AS last, x // w AS r, x % w AS c, {keys}
          FROM sized s, (VALUES {turns}) AS ep(epoch))""",
    ]
    for k in range(6):
        by, moved = ("c", "r") if k % 2 else ("r", "c")
        length = "CASE WHEN c < last THEN high ELSE high - 1 END" if k % 2 else "CASE WHEN r < high - 1 THEN w ELSE last END"
        first = f"(SELECT *, ({by} * m{k} + c{k}) % 2147483647 AS t FROM turn_{k})"
        turned = f"({moved} + (t * t % 2147483647 * m{k} + t) % 2147483647) % ({length})"
        steps.append(f"turn_{k + 1} AS (SELECT * EXCLUDE (t) REPLACE ({turned} AS {moved}) FROM {first})")
    steps.append(f"""permuted AS MATERIALIZED (SELECT id, epoch, CAST((r * w + c) // ({size}) AS BIGINT) AS batch_id FROM turn_6
      WHERE (r * w + c) // ({size}) < n // ({size}))""")
    return ",\n      ".join(steps)


@query(
    "batch_permuted",
    f"""WITH {permuted_sql(f'SELECT o_orderkey AS id, {ORDER} AS key FROM orders', 64, 5, 3)}
    SELECT id AS o_orderkey, epoch, batch_id FROM permuted""",
)
def batch_permuted(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return split.permuted_batches(orders, row_key("o_orderkey"), 64, epochs=3, seed=5)


# ---------------------------------------------------------------- scaling

LINE_SPLIT = f"SELECT *, {q.split(q.LINE_KEY)} AS split FROM lineitem"


def line_table(spark, sf):
    return split.hash_split(wide_table(spark, sf, "lineitem"), line_key())


def is_train():
    return F.col("split") == "train"


@query(
    "standardize",
    f"""WITH s AS ({LINE_SPLIT}), f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE_COLS)}
      FROM s WHERE split = 'train')
    SELECT {q.LINE_IDS}, split, {', '.join(f'round(({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0e0 ELSE s_{c} END), 6) AS {c}' for c in LINE_COLS)}
    FROM s, f""",
)
def standardize(spark, sf):
    lines = line_table(spark, sf)
    fitted = scale.fit(lines, LINE_COLS, ("mean", "std"), is_train())
    out = scale.standardise(lines, fitted)
    return out.select(*LINE_IDS, "split", *[F.round(c, 6).alias(c) for c in LINE_COLS])


def _minmax_fit(cols=LINE_COLS, source="s"):
    return f"SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in cols)} FROM {source} WHERE split = 'train'"


@query(
    "minmax",
    f"""WITH s AS ({LINE_SPLIT}), f AS ({_minmax_fit()})
    SELECT {q.LINE_IDS}, split, {', '.join(f"round({q.minmax(c, f'lo_{c}', f'hi_{c}')}, 9) AS {c}" for c in LINE_COLS)} FROM s, f""",
)
def minmax(spark, sf):
    lines = line_table(spark, sf)
    out = scale.scale_min_max(lines, scale.fit(lines, LINE_COLS, where=is_train()))
    return out.select(*LINE_IDS, "split", *[F.round(c, 9).alias(c) for c in LINE_COLS])


@query(
    "std_minmax",
    f"""WITH s AS ({LINE_SPLIT}), f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE_COLS)}
      FROM s WHERE split = 'train'),
      z AS (SELECT {q.LINE_IDS}, split, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in LINE_COLS)} FROM s, f),
      g AS ({_minmax_fit(source='z')})
    SELECT {q.LINE_IDS}, split, {', '.join(f"round({q.minmax(c, f'lo_{c}', f'hi_{c}')}, 6) AS {c}" for c in LINE_COLS)} FROM z, g""",
)
def std_minmax(spark, sf):
    """The check SQL really runs both scalers; here they are one affine map."""
    lines = line_table(spark, sf)
    out = scale.standardise_then_min_max(lines, scale.fit(lines, LINE_COLS, where=is_train()))
    return out.select(*LINE_IDS, "split", *[F.round(c, 6).alias(c) for c in LINE_COLS])


ORDER_GAPS = {"price": 0.1}
GAP_ORDERS = f"SELECT o_orderkey, {q.split(ORDER)} AS split, {gaps_sql(ORDER_GAPS, ORDER, 'o_totalprice')} FROM orders"


@query(
    "scale_by_mechanism",
    f"""WITH s AS ({GAP_ORDERS}), f AS (SELECT min(price) AS lo, max(price) AS hi FROM s WHERE split = 'train')
    SELECT o_orderkey, split, round(coalesce({q.minmax('price', 'lo', 'hi', -3.0, 3.0)}, 0.0e0), 9) AS raw_x,
      round(coalesce({q.minmax('price', 'lo', 'hi', -3.0, 3.0)}, 0.0e0), 9) AS pm_x, price AS qm_x FROM s, f""",
)
def scale_by_mechanism(spark, sf):
    orders = split.hash_split(table(spark, sf, "orders"), row_key("o_orderkey"))
    gaps = with_gaps(orders, row_key("o_orderkey"), ORDER_GAPS, "o_totalprice")
    base = gaps.select("o_orderkey", "split", *[F.col("price").alias(f"{m}_x") for m in ("raw", "pm", "qm")])
    fitted = scale.fit(base, ["raw_x", "pm_x", "qm_x"], where=is_train())
    for m in ("raw", "pm", "qm"):
        base = scale.scale_for_model(base, fitted, m, 7, [f"{m}_x"])
    return base.select("o_orderkey", "split", F.round("raw_x", 9).alias("raw_x"), F.round("pm_x", 9).alias("pm_x"), "qm_x")


@query(
    "mean_impute",
    f"""WITH s AS (SELECT *, {q.split(EVENT)} AS split FROM ({GAP_EVENTS})),
      f AS (SELECT avg(value_a) AS a, avg(value_b) AS b, avg(value_c) AS c FROM s WHERE split = 'train')
    SELECT event_id, split, round(coalesce(value_a, a), 6) AS value_a, round(coalesce(value_b, b), 6) AS value_b,
      round(coalesce(value_c, c), 6) AS value_c FROM s, f""",
)
def mean_impute(spark, sf):
    events = split.hash_split(gap_events(spark, sf), row_key("event_id"))
    out = scale.impute_mean(events, scale.fit(events, list(GAPS), ("mean",), is_train()))
    return out.select("event_id", "split", *[F.round(c, 6).alias(c) for c in GAPS])


@query(
    "label_range",
    f"""SELECT round(min(ln(1.0e0 + o_totalprice)), 9) AS label_min, round(max(ln(1.0e0 + o_totalprice)), 9) AS label_max
    FROM orders WHERE {q.split(ORDER)} = 'train'""",
)
def label_range(spark, sf):
    orders = split.hash_split(profile.log_label(table(spark, sf, "orders"), "o_totalprice"), row_key("o_orderkey"))
    train = orders.where(is_train())
    return train.agg(F.round(F.min("o_totalprice"), 9).alias("label_min"), F.round(F.max("o_totalprice"), 9).alias("label_max"))


# ---------------------------------------------------------------- categories


def _ordinal_sql(table_name: str, key: str, column: str) -> str:
    return f"""WITH s AS (SELECT {key}, {column}, {q.split(q.text(key))} AS split FROM {table_name}),
      c AS (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS code FROM (SELECT DISTINCT {column} FROM s WHERE split = 'train'))
    SELECT {key}, split, {column}, CAST(coalesce(code, -1) AS BIGINT) AS code FROM s LEFT JOIN c ON {column} = v"""


def _ordinal(spark, sf, name, key, column):
    df = split.hash_split(table(spark, sf, name).select(key, column), row_key(key))
    cats = encode.categories(df, column, is_train())
    out = encode.ordinal_encode(df, column, cats, "code")
    return out.select(key, "split", column, "code")


@query("ordinal_encode", _ordinal_sql("part", "p_partkey", "p_name"))
def ordinal_encode(spark, sf):
    return _ordinal(spark, sf, "part", "p_partkey", "p_name")


@query("ordinal_encode_many", _ordinal_sql("customer", "c_custkey", "c_name"))
def ordinal_encode_many(spark, sf):
    """One category per customer: the codes come from a distributed rank and a join."""
    return _ordinal(spark, sf, "customer", "c_custkey", "c_name")


@query(
    "category_set",
    f"""SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code, CAST(count(*) OVER () AS BIGINT) AS k
    FROM (SELECT DISTINCT event_type FROM events WHERE {q.split(EVENT)} = 'train')""",
)
def category_set(spark, sf):
    events = split.hash_split(table(spark, sf, "events").select("event_id", "event_type"), row_key("event_id"))
    cats = encode.categories(events, "event_type", is_train())
    return cats.table.select(F.col("value").alias("event_type"), "code", F.lit(cats.size).cast("bigint").alias("k"))


@query(
    "unknown_categories",
    f"""WITH s AS (SELECT c_name, {q.split(q.text('c_custkey'))} AS split FROM customer)
    SELECT DISTINCT c_name FROM s WHERE c_name NOT IN (SELECT c_name FROM s WHERE split = 'train')""",
)
def unknown_categories(spark, sf):
    customers = split.hash_split(table(spark, sf, "customer"), row_key("c_custkey"))
    return encode.unknown_values(customers, "c_name", encode.categories(customers, "c_name", is_train()))


@query(
    "one_hot_class",
    """WITH c AS (SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events)
    SELECT event_id, """
    + ", ".join(f"CASE WHEN code = {k} THEN 1.0e0 ELSE 0.0e0 END AS y{k}" for k in range(5))
    + " FROM c",
)
def one_hot_class(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    cats = encode.categories(events, "event_type")
    coded = encode.ordinal_encode(events, "event_type", cats, "code")
    return encode.one_hot(coded, "code", 5, "y").select("event_id", *[f"y{k}" for k in range(5)])


@query(
    "one_hot_features",
    """SELECT o_orderkey, o_totalprice, """
    + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS \"{c}_{v}\""
        for c, vs in (("o_orderstatus", "FOP"), ("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
        for v in vs
    )
    + " FROM orders",
)
def one_hot_features(spark, sf):
    columns = ["o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", *columns)
    train = ~split.is_test(row_key("o_orderkey"))
    fitted = {c: encode.categories(orders, c, train) for c in columns}
    return encode.one_hot_categorical(orders, columns, fitted)


@query(
    "class_log_priors",
    """WITH c AS (SELECT p_type AS class, count(*) AS n FROM part GROUP BY p_type), s AS (SELECT sum(n) AS total FROM c)
    SELECT class, round(least(greatest(n / total, 1e-9), 1 - 1e-9), 9) AS proportion,
      round(ln(least(greatest(n / total, 1e-9), 1 - 1e-9)), 9) AS log_prior FROM c, s""",
)
def class_log_priors(spark, sf):
    priors = encode.class_log_priors(table(spark, sf, "part"), "p_type")
    return priors.select("class", F.round("proportion", 9).alias("proportion"), F.round("log_prior", 9).alias("log_prior"))


@query(
    "label_log_odds",
    """SELECT round(avg(quality), 9) AS label_mean, round(ln(avg(quality) / (1 - avg(quality))), 9) AS log_odds FROM labels""",
)
def label_log_odds(spark, sf):
    priors = encode.label_priors(table(spark, sf, "labels"), "quality")
    return priors.select(F.round("label_mean", 9).alias("label_mean"), F.round("log_odds", 9).alias("log_odds"))


# ---------------------------------------------------------------- row identity joins


@query(
    "rows_by_ids",
    f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {q.split(ORDER)} = 'test'",
)
def rows_by_ids(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ids = orders.where(split.is_test(row_key("o_orderkey"))).select("o_orderkey")
    return lookup.select_by_ids(orders, ids, "o_orderkey")


@query(
    "align_truth",
    f"""SELECT o_orderkey, round(o_totalprice * 0.9e0, 4) AS pred, o_totalprice AS truth FROM orders
    WHERE {q.split(ORDER)} = 'test'""",
)
def align_truth(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    predictions = orders.where(split.is_test(row_key("o_orderkey"))).select(
        "o_orderkey", F.round(F.col("o_totalprice") * 0.9, 4).alias("pred")
    )
    return lookup.align(predictions, orders, "o_orderkey", "o_totalprice")
