"""Training, scoring, evaluation, reports, and whole comparisons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ldpspark.functions.rand import row_key, uniform
from ldpspark.operators import encode, evaluate, privatise, scale, score, sparse, split, train
from ldpspark.plans import compare as cmp
from ldpspark.plans.config import Dataset, Run, pm_grid, qm_grid
from ldpspark.plans.privatise import fit_dataset, prepare
from ldpspark.plans.privatise import privatise as privatise_runs
from ldpspark.session import scratch_path
from ldpspark.sources import runstore

from . import sqltext as q
from . import trainsql as ts
from .noise_queries import noise_columns
from .prepare_queries import EVENT, LINE_IDS, ORDER, PART, is_train, permuted_sql
from .registry import query, table, wide_table

# ---------------------------------------------------------------- data sets

DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
PRICE = "o_totalprice / 250000.0e0 - 1.0e0"


def scaled_sql(source: str, key: str, features, label: str, lo: float = -3.0, hi: float = 3.0) -> str:
    """CTEs raw(key, split, features, y), fit, data(exp = 0, key, split, features scaled, y)."""
    fits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in features)
    cols = ", ".join(f"{q.minmax(c, f'lo_{c}', f'hi_{c}', lo, hi)} AS {c}" for c in features)
    return f"""raw AS MATERIALIZED ({source}), fit AS (SELECT {fits} FROM raw WHERE split = 'train'),
      data AS MATERIALIZED (SELECT 0 AS exp, {key}, split, {cols}, {label} AS y FROM raw, fit)"""


ORDERS_RAW = f"""SELECT o_orderkey, {q.split(ORDER)} AS split, CAST({DAY} AS DOUBLE) AS day, CAST(o_custkey AS DOUBLE) AS o_custkey,
        {PRICE} AS price FROM orders"""
ORDERS_DATA = scaled_sql(ORDERS_RAW, "o_orderkey", ("day", "o_custkey"), "price")

DOCS_RAW = f"""SELECT l.doc_id, {q.split(q.text('l.doc_id'))} AS split, CAST(n_chars AS DOUBLE) AS n_chars,
        CAST(len(string_split(text, ' ')) AS DOUBLE) AS words, CAST(quality AS DOUBLE) AS quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
DOCS_DATA = scaled_sql(DOCS_RAW, "doc_id", ("n_chars", "words"), "quality")


def vectors_raw(d: int) -> str:
    cols = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(d))
    return f"SELECT vec_id, {q.split(q.text('vec_id'))} AS split, {cols}, label FROM embeddings"


def train_xy(key: str, features, y: str = "SELECT exp, {key} AS id, 0 AS c, y FROM data WHERE split = 'train'") -> str:
    return f"""x AS MATERIALIZED ({ts.long_x('data', key, features, "split = 'train'")}), y AS MATERIALIZED ({y.format(key=key)})"""


def class_y(k: int, source: str = "data") -> str:
    """One row per class; class codes are the rank of the train label."""
    return f"""SELECT d.exp, d.{{key}} AS id, c.c, CASE WHEN d.y = c.v THEN 1.0e0 ELSE 0.0e0 END AS y FROM {source} d
        JOIN (SELECT exp, v, CAST(row_number() OVER (PARTITION BY exp ORDER BY v) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT exp, y AS v FROM {source} WHERE split = 'train')) c
        ON c.exp = d.exp WHERE d.split = 'train'"""


def order_data(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"),
        F.col("o_custkey").cast("double").alias("o_custkey"),
        (F.col("o_totalprice") / 250000.0 - 1.0).alias("y"),
    )
    return scaled(split.hash_split(orders, row_key("o_orderkey")), ["day", "o_custkey"])


def scaled(df, features):
    return scale.scale_min_max(df, scale.fit(df, features, where=is_train()), -3.0, 3.0)


def docs_raw(spark, sf):
    # words are counted before the join, so that texts are not shuffled
    words = F.size(F.split("text", " ", -1)).cast("double")
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.alias("words"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")).join(docs, "doc_id")


def docs_data(spark, sf):
    df = split.hash_split(docs_raw(spark, sf).withColumnRenamed("quality", "y"), row_key("doc_id"))
    return scaled(df, ["n_chars", "words"])


def vector_table(spark, sf, d: int):
    xs = [F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(d)]
    df = table(spark, sf, "embeddings").select("vec_id", *xs, "label")
    return split.hash_split(df, row_key("vec_id"))


def vector_data(spark, sf, d: int):
    df = vector_table(spark, sf, d)
    cats = encode.categories(df, "label", is_train())
    return scaled(encode.ordinal_encode(df, "label", cats, "y"), [f"x{k}" for k in range(d)])


def beta_sql(last: str, names, digits: int = 8) -> str:
    label = " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(["(bias)", *names]))
    return f"SELECT CAST(exp AS INTEGER) AS exp, CAST(c AS INTEGER) AS class, CASE f {label} END AS feature, round(b, {digits}) AS beta FROM {last}"


def beta_rows(spark, betas, features, digits: int = 8):
    return train.coefficient_table(spark, betas, features).withColumn("beta", F.round("beta", digits))


# ---------------------------------------------------------------- training


@query(
    "linear_gd",
    f"WITH {ORDERS_DATA}, {train_xy('o_orderkey', ('day', 'o_custkey'))}, {ts.train_ctes('linear', 5)} {beta_sql('beta_5', ('day', 'o_custkey'))}",
)
def linear_gd(spark, sf):
    """Five full-batch epochs from one pass over the rows."""
    cfg = train.TrainConfig("linear", epochs=5)
    features = ["day", "o_custkey"]
    return beta_rows(spark, train.train_linear(order_data(spark, sf).where(is_train()), features, "y", cfg), features)


def _minibatch_sql() -> str:
    # moments per batch, replayed in order; the number of steps depends on the table
    n = ("m", "s1", "s2", "s11", "s12", "s22", "sy", "s1y", "s2y")
    sums = "count(*), sum(day), sum(o_custkey), sum(day * day), sum(day * o_custkey), sum(o_custkey * o_custkey), sum(y), sum(day * y), sum(o_custkey * y)"
    listed = ", ".join(f"{s} AS {a}" for s, a in zip(sums.split(", "), n))
    return f"""WITH RECURSIVE {ORDERS_DATA},
      h AS (SELECT d.*, ep.epoch, md5(concat_ws('|', '', '0', 'epoch' || CAST(ep.epoch AS VARCHAR), {ORDER}, '')) AS hx
        FROM data d, (VALUES (0), (1)) AS ep(epoch) WHERE split = 'train'),
      r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY hx) - 1 AS n, count(*) OVER (PARTITION BY epoch) AS total FROM h),
      g AS MATERIALIZED (SELECT epoch * (min(total) // 1024) + n // 1024 AS k, {listed} FROM r WHERE n // 1024 < total // 1024 GROUP BY epoch, n // 1024),
      gd(k, b0, b1, b2) AS (
        SELECT CAST(0 AS BIGINT), avg(y), 0.0e0, 0.0e0 FROM data WHERE split = 'train'
        UNION ALL
        SELECT k + 1, greatest(least(b0 - 0.05e0 * g0 * sc, 1), -1), greatest(least(b1 - 0.05e0 * g1 * sc, 1), -1), greatest(least(b2 - 0.05e0 * g2 * sc, 1), -1)
        FROM (SELECT *, CASE WHEN sqrt(g0 * g0 + g1 * g1 + g2 * g2) > 1 THEN 1 / sqrt(g0 * g0 + g1 * g1 + g2 * g2) ELSE 1.0e0 END AS sc FROM (
          SELECT gd.k, b0, b1, b2, 2 * (m * b0 + s1 * b1 + s2 * b2 - sy) / 1024.0e0 AS g0,
            2 * (s1 * b0 + s11 * b1 + s12 * b2 - s1y) / 1024.0e0 + 0.2e0 * b1 AS g1,
            2 * (s2 * b0 + s12 * b1 + s22 * b2 - s2y) / 1024.0e0 + 0.2e0 * b2 AS g2 FROM gd JOIN g ON g.k = gd.k)))
    SELECT 0 AS exp, 0 AS class, feature, round(b, 8) AS beta FROM (SELECT * FROM gd ORDER BY k DESC LIMIT 1),
      LATERAL (VALUES ('(bias)', b0), ('day', b1), ('o_custkey', b2)) AS t(feature, b)"""


@query("linear_minibatch", _minibatch_sql())
def linear_minibatch(spark, sf):
    cfg = train.TrainConfig("linear", epochs=2, batch_size=1024)
    features = ["day", "o_custkey"]
    rows = order_data(spark, sf).where(is_train())
    return beta_rows(spark, train.train_linear(rows, features, "y", cfg, row_key("o_orderkey")), features)


@query(
    "logistic_gd",
    f"WITH {DOCS_DATA}, {train_xy('doc_id', ('n_chars', 'words'))}, {ts.train_ctes('logistic', 3)} {beta_sql('beta_3', ('n_chars', 'words'))}",
)
def logistic_gd(spark, sf):
    cfg = train.TrainConfig("logistic", epochs=3)
    features = ["n_chars", "words"]
    return beta_rows(spark, train.train_logistic(docs_data(spark, sf).where(is_train()), features, "y", cfg), features)


def _batch_rows(k: int) -> str:
    return f"(SELECT exp, id FROM batches WHERE n // (total // 2) = {k})"


@query(
    "logistic_minibatch",
    f"""WITH {DOCS_DATA}, {train_xy('doc_id', ('n_chars', 'words'))},
      batches AS (SELECT exp, doc_id AS id, row_number() OVER (ORDER BY {q.h(4, 'epoch0', q.text('doc_id'))}) - 1 AS n, count(*) OVER () AS total FROM data WHERE split = 'train'),
      {ts.train_ctes('logistic', 2, batch=_batch_rows)} {beta_sql('beta_2', ('n_chars', 'words'))}""",
)
def logistic_minibatch(spark, sf):
    """Two batches per epoch, whatever the size of the table; an odd last row is left out."""
    features = ["n_chars", "words"]
    rows = docs_data(spark, sf).where(is_train())
    cfg = train.TrainConfig("logistic", epochs=1, batch_size=rows.count() // 2, seed=4)
    return beta_rows(spark, train.train_logistic(rows, features, "y", cfg, row_key("doc_id")), features)


def _permuted_rows(k: int) -> str:
    # steps 0 and 1 are the batches of the first epoch, 2 and 3 those of the second
    return f"(SELECT 0 AS exp, id FROM permuted WHERE epoch * 2 + batch_id = {k})"


@query(
    "logistic_permuted",
    f"""WITH {DOCS_DATA}, {train_xy('doc_id', ('n_chars', 'words'))},
      {permuted_sql(f"SELECT doc_id AS id, {q.text('doc_id')} AS key FROM data WHERE split = 'train'", '(n // 2)', 4, 2)},
      {ts.train_ctes('logistic', 4, batch=_permuted_rows)} {beta_sql('beta_4', ('n_chars', 'words'))}""",
)
def logistic_permuted(spark, sf):
    """Two epochs of two batches; rows are ranked once and every epoch permutes the ranks."""
    features = ["n_chars", "words"]
    rows = docs_data(spark, sf).where(is_train())
    cfg = train.TrainConfig("logistic", epochs=2, batch_size=rows.count() // 2, seed=4, order="permuted")
    return beta_rows(spark, train.train_logistic(rows, features, "y", cfg, row_key("doc_id")), features)


def _sparse_sql(steps: int) -> str:
    coded = """SELECT *, 2 + dense_rank() OVER (ORDER BY o_custkey) - 1 AS f1,
        2 + (SELECT count(DISTINCT o_custkey) FROM raw_t) + dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS f2 FROM raw_t"""
    return f"""WITH raw_t AS MATERIALIZED (SELECT o_orderkey, CAST({DAY} AS DOUBLE) AS day, o_custkey, o_orderpriority,
          CASE WHEN o_totalprice > 250000 THEN 1.0e0 ELSE 0.0e0 END AS y FROM orders WHERE {q.split(ORDER)} = 'train'),
      fit AS (SELECT min(day) AS lo, max(day) AS hi FROM raw_t), coded AS MATERIALIZED ({coded}),
      names AS (SELECT DISTINCT f1 AS f, 'o_custkey' AS feature, CAST(o_custkey AS VARCHAR) AS category FROM coded
        UNION SELECT DISTINCT f2, 'o_orderpriority', o_orderpriority FROM coded
        UNION ALL VALUES (0, '(bias)', NULL), (1, 'day', NULL)),
      x AS MATERIALIZED (SELECT 0 AS exp, o_orderkey AS id, 0 AS f, 1.0e0 AS x FROM coded
        UNION ALL SELECT 0, o_orderkey, 1, {q.minmax('day', 'lo', 'hi', -3.0, 3.0)} FROM coded, fit
        UNION ALL SELECT 0, o_orderkey, f1, 1.0e0 FROM coded UNION ALL SELECT 0, o_orderkey, f2, 1.0e0 FROM coded),
      y AS MATERIALIZED (SELECT 0 AS exp, o_orderkey AS id, 0 AS c, y FROM coded),
      {ts.train_ctes('logistic', steps)}
    SELECT feature, category, round(b, 8) AS beta FROM beta_{steps} JOIN names USING (f)"""


@query("logistic_sparse", _sparse_sql(2))
def logistic_sparse(spark, sf):
    """A coefficient per customer and priority, trained from sparse cells."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"),
        "o_custkey",
        "o_orderpriority",
        (F.col("o_totalprice") > 250000).cast("double").alias("y"),
    )
    rows = scaled(split.hash_split(orders, row_key("o_orderkey")), ["day"]).where(is_train())
    columns = ["o_custkey", "o_orderpriority"]
    fitted = {c: encode.categories(rows, c) for c in columns}
    models = sparse.train_sparse(rows, ["o_orderkey"], ["day"], columns, fitted, "y", train.TrainConfig("logistic", epochs=2))
    names = None
    for c in columns:
        part = fitted[c].table.select(F.lit(c).alias("column"), "code", F.col("value").cast("string").alias("category"))
        names = part if names is None else names.unionByName(part)
    found = models.table.join(names, ["column", "code"]).select(F.col("column").alias("feature"), "category", "beta")
    dense = [(n, None, float(v)) for n, v in zip(["(bias)", "day"], models.dense[0])]
    few = spark.createDataFrame(dense, "feature string, category string, beta double")
    return found.unionByName(few).withColumn("beta", F.round("beta", 8))


def _softmax_sql(d: int, steps: int) -> str:
    xs = tuple(f"x{k}" for k in range(d))
    data = scaled_sql(vectors_raw(d), "vec_id", xs, "label")
    return f"WITH {data}, {train_xy('vec_id', xs, class_y(10))}, {ts.train_ctes('softmax', steps)} {beta_sql(f'beta_{steps}', xs)}"


def _softmax(spark, sf, d: int, steps: int):
    features = [f"x{k}" for k in range(d)]
    cfg = train.TrainConfig("softmax", epochs=steps)
    return beta_rows(spark, train.train_softmax(vector_data(spark, sf, d).where(is_train()), features, "y", cfg), features)


@query("softmax_gd", _softmax_sql(4, 2))
def softmax_gd(spark, sf):
    return _softmax(spark, sf, 4, 2)


@query("softmax_wide", _softmax_sql(64, 2))
def softmax_wide(spark, sf):
    """650 parameters: partitions compute partial gradients with numpy."""
    return _softmax(spark, sf, 64, 2)


def _linear_wide_sql(d: int, steps: int) -> str:
    xs = tuple(f"x{k}" for k in range(d))
    data = scaled_sql(vectors_raw(d), "vec_id", xs, "label / 10.0e0")
    return f"WITH {data}, {train_xy('vec_id', xs)}, {ts.train_ctes('linear', steps)} {beta_sql(f'beta_{steps}', xs)}"


@query("linear_wide", _linear_wide_sql(64, 3))
def linear_wide(spark, sf):
    """2,145 moments: partial sums with numpy."""
    features = [f"x{k}" for k in range(64)]
    rows = scaled(vector_table(spark, sf, 64), features).withColumn("y", F.col("label") / 10.0)
    return beta_rows(spark, train.train_linear(rows.where(is_train()), features, "y", train.TrainConfig("linear", epochs=3)), features)


# ---------------------------------------------------------------- missing cells

X64 = tuple(f"x{k}" for k in range(64))


def _holes_sql(label: str) -> str:
    """Vectors with keyed gaps in features and label."""
    cols = ", ".join(f"CASE WHEN (vec_id * 31 + {k}) % 997 <> 0 THEN CAST(embedding[{k + 1}] AS DOUBLE) END AS x{k}" for k in range(64))
    source = f"SELECT vec_id, {q.split(q.text('vec_id'))} AS split, {cols}, CASE WHEN vec_id % 101 <> 3 THEN label END AS label FROM embeddings"
    return scaled_sql(source, "vec_id", X64, label)


def _with_holes(spark, sf):
    gaps = {f"x{k}": F.when((F.col("vec_id") * 31 + k) % 997 != 0, F.col(f"x{k}")) for k in range(64)}
    return scaled(vector_table(spark, sf, 64).withColumns(gaps | {"label": F.when(F.col("vec_id") % 101 != 3, F.col("label"))}), X64)


def _linear_holes_sql(steps: int) -> str:
    # a missing cell drops the products it is in, as a zero does
    zeros = ", ".join(f"coalesce({c}, 0.0e0) AS {c}" for c in (*X64, "y"))
    return f"""WITH {_holes_sql('label / 10.0e0')}, filled AS MATERIALIZED (SELECT exp, vec_id, split, {zeros} FROM data),
      x AS MATERIALIZED ({ts.long_x('filled', 'vec_id', X64, "split = 'train'")}),
      y AS MATERIALIZED (SELECT exp, vec_id AS id, 0 AS c, y FROM filled WHERE split = 'train'),
      {ts.train_ctes('linear', steps)} {beta_sql(f'beta_{steps}', X64)}"""


@query("linear_wide_nulls", _linear_holes_sql(3))
def linear_wide_nulls(spark, sf):
    """Missing cells on the numpy path: each drops its own products, and rows keep counting."""
    rows = _with_holes(spark, sf).withColumn("y", F.col("label") / 10.0)
    return beta_rows(spark, train.train_linear(rows.where(is_train()), X64, "y", train.TrainConfig("linear", epochs=3)), X64)


def _row_holes_sql(model: str, label: str, y: str, steps: int) -> str:
    # gradients skip rows with a gap; the row counts do not
    whole = " AND ".join(f"{c} IS NOT NULL" for c in X64)
    return f"""WITH {_holes_sql(label)}, x AS MATERIALIZED ({ts.long_x('data', 'vec_id', X64, f"split = 'train' AND {whole}")}),
      y AS MATERIALIZED ({y}), {ts.train_ctes(model, steps)} {beta_sql(f'beta_{steps}', X64)}"""


@query(
    "logistic_wide_nulls",
    _row_holes_sql(
        "logistic",
        "CASE WHEN label >= 5 THEN 1.0e0 WHEN label < 5 THEN 0.0e0 END",
        "SELECT exp, vec_id AS id, 0 AS c, y FROM data WHERE split = 'train'",
        2,
    ),
)
def logistic_wide_nulls(spark, sf):
    rows = _with_holes(spark, sf).withColumn("y", (F.col("label") >= 5).cast("double"))
    return beta_rows(spark, train.train_logistic(rows.where(is_train()), X64, "y", train.TrainConfig("logistic", epochs=2)), X64)


@query(
    "softmax_wide_nulls",
    _row_holes_sql(
        "softmax",
        "label",
        """SELECT d.exp, d.vec_id AS id, c.c, CASE WHEN d.y = c.v THEN 1.0e0 WHEN d.y <> c.v THEN 0.0e0 END AS y FROM data d,
          (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT y AS v FROM data WHERE split = 'train' AND y IS NOT NULL)) c
          WHERE d.split = 'train'""",
        2,
    ),
)
def softmax_wide_nulls(spark, sf):
    df = _with_holes(spark, sf)
    coded = encode.ordinal_encode(df, "label", encode.categories(df, "label", is_train()), "y", unknown=None)
    return beta_rows(spark, train.train_softmax(coded.where(is_train()), X64, "y", train.TrainConfig("softmax", epochs=2)), X64)


@query(
    "softmax_minibatch",
    f"""WITH {scaled_sql(vectors_raw(4), 'vec_id', X64[:4], 'label')}, {train_xy('vec_id', X64[:4], class_y(10))},
      batches AS (SELECT exp, vec_id AS id, row_number() OVER (ORDER BY {q.h(4, 'epoch0', q.text('vec_id'))}) - 1 AS n, count(*) OVER () AS total FROM data WHERE split = 'train'),
      {ts.train_ctes('softmax', 2, batch=_batch_rows)} {beta_sql('beta_2', X64[:4])}""",
)
def softmax_minibatch(spark, sf):
    """Two batches of one epoch."""
    features = list(X64[:4])
    rows = vector_data(spark, sf, 4).where(is_train())
    cfg = train.TrainConfig("softmax", epochs=1, batch_size=rows.count() // 2, seed=4)
    return beta_rows(spark, train.train_softmax(rows, features, "y", cfg, row_key("vec_id")), features)


# ---------------------------------------------------------------- many models at once

DOC_RUNS = pm_grid(eps=(1.0, 3.0), t=(3.0,), modes=("none",), seeds=(0, 1))
DOC_FEATURES = ("n_chars", "words")
DOC_SET = Dataset("docs", ("doc_id",), "quality", DOC_FEATURES)


def pm_copy_sql(run: Run, exp: int, source: str, key: str, features, label: str) -> str:
    """One privatised copy: train rows perturbed, test rows drawn from the core; raw label."""
    ktext = q.text(key)
    hashed = ", ".join(f"{q.h(run.seed, 'pm', ktext, c)} AS h_{c}" for c in features)
    values = ", ".join(f"{q.minmax(c, f'lo_{c}', f'hi_{c}')} AS v_{c}" for c in features)
    draws = ", ".join(f"{q.u(f'h_{c}', 0)} AS a_{c}, {q.u(f'h_{c}', 1)} AS b_{c}" for c in features)

    def one(c):
        l, r = q.pm_core(f"v_{c}", run.eps, run.t)
        return f"CASE WHEN split = 'test' THEN {l} + ({r} - {l}) * a_{c} ELSE {q.pm(f'v_{c}', f'a_{c}', f'b_{c}', run.eps, run.t)} END AS {c}"

    fits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in features)
    return f"""SELECT {exp} AS exp, {key}, split, {', '.join(one(c) for c in features)}, y FROM (SELECT *, {draws} FROM (
        SELECT {key}, split, {hashed}, {values}, {label} AS y FROM {source}, (SELECT {fits} FROM {source} WHERE split = 'train')))"""


def stacked_sql(raw: str, copies: list[str], key: str, features, label: str) -> str:
    """CTEs raw, copies, data: raw (exp 0) and copies, scaled per model to [-3, 3]."""
    fits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in features)
    cols = ", ".join(f"{q.minmax(c, f'lo_{c}', f'hi_{c}', -3.0, 3.0)} AS {c}" for c in features)
    listed = ", ".join(features)
    union = " UNION ALL ".join([f"SELECT 0 AS exp, {key}, split, {listed}, {label} AS y FROM raw", *copies])
    return f"""raw AS MATERIALIZED ({raw}), stacked AS MATERIALIZED ({union}),
      fit AS (SELECT exp AS fexp, {fits} FROM stacked WHERE split = 'train' GROUP BY exp),
      data AS MATERIALIZED (SELECT exp, {key}, split, {cols}, y FROM stacked JOIN fit ON fexp = exp)"""


DOC_STACK = stacked_sql(
    DOCS_RAW,
    [pm_copy_sql(r, n + 1, "raw", "doc_id", DOC_FEATURES, "quality") for n, r in enumerate(DOC_RUNS)],
    "doc_id",
    DOC_FEATURES,
    "quality",
)


@query(
    "grid_train",
    f"WITH {DOC_STACK}, {train_xy('doc_id', DOC_FEATURES)}, {ts.train_ctes('logistic', 3)} {beta_sql('beta_3', DOC_FEATURES, 7)}",
)
def grid_train(spark, sf):
    """Raw data and four privatised copies, trained together."""
    cfg = cmp.CompareConfig(train.TrainConfig("logistic", epochs=3))
    prepared = prepare(docs_raw(spark, sf), DOC_SET)
    fitted = fit_dataset(prepared, DOC_SET)
    experiments = cmp.plan_experiments(DOC_RUNS, cfg)
    stacked = cmp.stack(prepared, privatise_runs(prepared, fitted, DOC_RUNS), DOC_SET, DOC_FEATURES, experiments)
    ready, _ = cmp.fitted_columns(stacked, DOC_FEATURES, experiments, True, 7)
    betas = train.train_logistic(ready.where(~F.col("is_test")), DOC_FEATURES, "y", cfg.train)
    return beta_rows(spark, betas, DOC_FEATURES, 7)


DOC_NAMES = " ".join(
    f"WHEN {n} THEN {q.d(r.eps)}" for n, r in enumerate(DOC_RUNS, start=1)
)


def _compare_logistic_sql(lr: float = 0.05, epochs: int = 3, named: str = "", failed: tuple[int, ...] = (-1,)) -> str:
    last = f"beta_{epochs}"
    tests = ts.long_x("data", "doc_id", DOC_FEATURES, "split = 'test'")
    eps = " ".join(f"WHEN {n} THEN {q.d(r.eps)}" for n, r in enumerate(DOC_RUNS, start=1))
    seeds = " ".join(f"WHEN {n} THEN {r.seed}" for n, r in enumerate(DOC_RUNS, start=1))
    return f"""WITH {DOC_STACK}, {train_xy('doc_id', DOC_FEATURES)}, {ts.train_ctes('logistic', epochs, lr=lr)},
      tx AS ({tests}), pr AS (SELECT exp, id, p AS score FROM ({ts.predictions('logistic', last, 'tx')})),
      sc AS MATERIALIZED (SELECT pr.exp, pr.score, r.quality AS y FROM pr JOIN raw r ON r.doc_id = pr.id),
      au AS (SELECT exp, auc FROM ({ts.auc_sql('sc', 'exp')})),
      yo AS ({ts.youden_sql('sc', 'exp')}),
      ac AS (SELECT sc.exp, avg(CASE WHEN (score >= threshold) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM sc JOIN yo ON yo.exp = sc.exp GROUP BY sc.exp),
      one AS (SELECT au.exp, round_even(acc, 3) AS acc, round_even(auc, 3) AS auc FROM au JOIN ac ON ac.exp = au.exp),
      named AS (SELECT CASE exp {eps} END AS eps, CASE exp {seeds} END AS seed, 'LDP-PM(T3)' AS variant, acc, auc FROM one WHERE exp > 0 AND exp NOT IN ({', '.join(map(str, failed))})
        UNION ALL SELECT e.eps, s.seed, 'Full', acc, auc FROM one, (VALUES (1.0e0), (3.0e0)) e(eps), (VALUES (0), (1)) s(seed) WHERE exp = 0)
    SELECT {named}'docs' AS dataset, eps, eps AS label_eps, 'none' AS mode, variant, round(avg(acc), 4) AS "Accuracy", round(avg(auc), 4) AS "AUC"
    FROM named GROUP BY eps, variant"""


@query("compare_logistic", _compare_logistic_sql())
def compare_logistic(spark, sf):
    """Privatise, train and score; per-seed scores rounded, then averaged."""
    cfg = cmp.CompareConfig(train.TrainConfig("logistic", epochs=3))
    scores = cmp.compare(docs_raw(spark, sf), DOC_SET, DOC_RUNS, cfg)
    keys = ["dataset", "eps", "label_eps", "mode", "variant"]
    means = scores.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("value"))
    return evaluate.wide_report(means, ["Accuracy", "AUC"], keys)


@query("compare_faulty", _compare_logistic_sql(failed=(1, 4)))
def compare_faulty(spark, sf):
    """One copy has an infinite train cell, another no train labels: they alone go without scores."""
    prepared = prepare(docs_raw(spark, sf), DOC_SET)
    made = privatise_runs(prepared, fit_dataset(prepared, DOC_SET), DOC_RUNS)
    some = (F.col("run") == 0) & (F.col("doc_id") % 50 == 1)
    none = (F.col("run") == 3) & (F.col("split") == "train")
    broken = made.withColumns(
        {
            "n_chars": F.when(some, F.lit(float("inf"))).otherwise(F.col("n_chars")),
            "quality": F.when(none, F.lit(None)).otherwise(F.col("quality")),
        }
    )
    cfg = cmp.CompareConfig(train.TrainConfig("logistic", epochs=3))
    scores = cmp.compare(docs_raw(spark, sf), DOC_SET, DOC_RUNS, cfg, privatised=broken)
    keys = ["dataset", "eps", "label_eps", "mode", "variant"]
    means = scores.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("value"))
    return evaluate.wide_report(means, ["Accuracy", "AUC"], keys)


GRID = [(lr, n) for lr in (0.05, 0.5) for n in (1, 3)]


@query(
    "train_grid",
    " UNION ALL ".join(
        f"SELECT * FROM ({_compare_logistic_sql(lr, n, f'-1 AS batch_size, {q.d(lr)} AS learning_rate, {n} AS epochs, ')})" for lr, n in GRID
    ),
)
def train_grid(spark, sf):
    """Learning rates and epochs over all budgets and seeds; the data are profiled and privatised once."""
    cfg = cmp.CompareConfig(train.TrainConfig("logistic"))
    scores = cmp.training_grid(
        docs_raw(spark, sf), DOC_SET, DOC_RUNS, cfg, learning_rates=sorted({lr for lr, _ in GRID}), epochs=sorted({n for _, n in GRID})
    )
    keys = ["batch_size", "learning_rate", "epochs", "dataset", "eps", "label_eps", "mode", "variant"]
    means = scores.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("value"))
    return evaluate.wide_report(means, ["Accuracy", "AUC"], keys)


# prices around 1, so that clipped parameters do not saturate
LINEAR_SET = Dataset("orders", ("o_orderkey",), "price", ("day", "o_custkey"))
LINEAR_RUNS = [
    Run("pm", 3.0, 0, "index"),
    Run("pm", 3.0, 0, "linear"),
    Run("qm", 3.0, 0, "index", n_outputs=7, label_n=7),
    Run("qm", 3.0, 0, "linear", n_outputs=7, label_n=7),
]


def orders_raw(spark, sf):
    return wide_table(spark, sf, "orders").select(
        "o_orderkey",
        F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"),
        F.col("o_custkey").cast("double").alias("o_custkey"),
        (F.col("o_totalprice") / 250000.0 - 1.0).alias("price"),
    )


def _compare_linear_sql() -> str:
    a = q.pm_constants(3.0, 3.0)["a"]
    feats = ("day", "o_custkey")
    v = {c: q.minmax(c, f"lo_{c}", f"hi_{c}") for c in (*feats, "price")}
    fits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in (*feats, "price"))

    def h(kind, c):
        return q.h(0, kind, ORDER, c)

    def pm_of(c):
        l, r = q.pm_core("v", 3.0, 3.0)
        return f"""SELECT o_orderkey, split, '{c}' AS col, CASE WHEN split = 'test' THEN {l} + ({r} - {l}) * u0 ELSE {q.pm('v', 'u0', 'u1', 3.0, 3.0)} END AS val
          FROM (SELECT o_orderkey, split, {v[c]} AS v, {q.u(h('pm', c), 0)} AS u0, {q.u(h('pm', c), 1)} AS u1 FROM raw, lim)"""

    qrows = " UNION ALL ".join(
        f"SELECT o_orderkey, split, '{c}' AS col, {v[c]} AS v, {q.u(h('qm', c))} AS u FROM raw, lim" for c in (*feats, "price")
    )
    wide = ", ".join(f"max(CASE WHEN col = '{c}' THEN val END) AS {c}" for c in (*feats, "price"))

    def copy(exp, src, label):
        return f"SELECT {exp} AS exp, o_orderkey, split, day, o_custkey, CASE WHEN split = 'test' THEN rawy ELSE {label} END AS y FROM {src}, lim"

    scale3 = ", ".join(
        f"CASE WHEN exp IN (3, 4) THEN {c} ELSE {q.minmax(c, f'flo_{c}', f'fhi_{c}', -3.0, 3.0)} END AS {c}" for c in feats
    )
    fits3 = ", ".join(f"min({c}) AS flo_{c}, max({c}) AS fhi_{c}" for c in feats)
    return f"""WITH {q.qm_tables(3.0, 7, 2)}, raw AS MATERIALIZED ({ORDERS_RAW}), lim AS (SELECT {fits} FROM raw WHERE split = 'train'),
      pmw AS MATERIALIZED (SELECT o_orderkey, split, {wide} FROM ({' UNION ALL '.join(pm_of(c) for c in (*feats, 'price'))}) GROUP BY o_orderkey, split),
      qr AS MATERIALIZED ({qrows}), qp AS MATERIALIZED ({q.qm_probability('qr', 'o_orderkey, split, col', 7)}),
      qs AS ({q.qm_sample('qr', 'o_orderkey, split, col', 7)}),
      qa AS (SELECT o_orderkey, split, col, CAST(min(pos) - 3 AS INTEGER) AS idx FROM (SELECT *, max(p) OVER (PARTITION BY o_orderkey, col) AS best FROM qp) WHERE p = best GROUP BY o_orderkey, split, col),
      ql AS (SELECT o_orderkey, split, col, CAST(idx AS DOUBLE) AS val FROM qs WHERE split = 'train' OR col = 'price'
        UNION ALL SELECT o_orderkey, split, col, CAST(idx AS DOUBLE) FROM qa WHERE split = 'test' AND col <> 'price'),
      qmw AS MATERIALIZED (SELECT o_orderkey, split, {wide} FROM ql GROUP BY o_orderkey, split),
      pmr AS (SELECT p.*, r.price AS rawy FROM pmw p JOIN raw r ON r.o_orderkey = p.o_orderkey),
      qmr AS (SELECT p.*, r.price AS rawy FROM qmw p JOIN raw r ON r.o_orderkey = p.o_orderkey),
      stacked AS MATERIALIZED (SELECT 0 AS exp, o_orderkey, split, day, o_custkey, price AS y FROM raw
        UNION ALL {copy(1, 'pmr', 'price')}
        UNION ALL {copy(2, 'pmr', f'(price + {q.d(a)}) / {q.d(2 * a)} * (hi_price - lo_price) + lo_price')}
        UNION ALL {copy(3, 'qmr', 'price')}
        UNION ALL {copy(4, 'qmr', '(price + 3) / 6.0e0 * (hi_price - lo_price) + lo_price')}),
      fit3 AS (SELECT exp AS fexp, {fits3} FROM stacked WHERE split = 'train' GROUP BY exp),
      data AS MATERIALIZED (SELECT exp, o_orderkey, split, {scale3}, y FROM stacked JOIN fit3 ON fexp = exp),
      {train_xy('o_orderkey', feats)}, {ts.train_ctes('linear', 5)},
      tx AS ({ts.long_x('data', 'o_orderkey', feats, "split = 'test'")}),
      pr AS (SELECT exp, id, z FROM ({ts.predictions('linear', 'beta_5', 'tx')})),
      inv AS (SELECT exp, r.price AS truth, CASE
          WHEN exp = 1 THEN (greatest(least(z, {q.d(a)}), {q.d(-a)}) + {q.d(a)}) / {q.d(2 * a)} * (hi_price - lo_price) + lo_price
          WHEN exp = 3 THEN (greatest(least(z, 3), -3) + 3) / 6.0e0 * (hi_price - lo_price) + lo_price
          ELSE z END AS pred FROM pr JOIN raw r ON r.o_orderkey = pr.id, lim),
      one AS (SELECT exp, round_even(sqrt(avg((truth - pred) * (truth - pred))), 3) AS rmse, round_even(avg(abs(truth - pred)), 3) AS mae FROM inv GROUP BY exp)
    SELECT 'orders' AS dataset, 3.0e0 AS eps, 3.0e0 AS label_eps, CASE WHEN exp IN (1, 3) THEN 'index' ELSE 'linear' END AS mode,
        CASE WHEN exp IN (1, 2) THEN 'LDP-PM(T3)' ELSE 'LDP-QM' END AS variant, rmse AS "RMSE", mae AS "MAE" FROM one WHERE exp > 0
    UNION ALL SELECT 'orders', 3.0e0, 3.0e0, mode, 'Full', rmse, mae FROM one, (VALUES ('index'), ('linear')) AS m(mode) WHERE exp = 0"""


@query("compare_linear", _compare_linear_sql())
def compare_linear(spark, sf):
    cfg = cmp.CompareConfig(train.TrainConfig("linear", epochs=5))
    return cmp.mean_report(cmp.compare(orders_raw(spark, sf), LINEAR_SET, LINEAR_RUNS, cfg), "linear")


@query("compare_stored", _compare_linear_sql())
def compare_stored(spark, sf):
    """The same from a store that holds the runs in another order, and more of them."""
    prepared = prepare(orders_raw(spark, sf), LINEAR_SET)
    root = scratch_path(spark, "linear-runs")
    others = [replace(r, seed=99) for r in LINEAR_RUNS[:1]]
    runstore.save_runs(privatise_runs(prepared, fit_dataset(prepared, LINEAR_SET), [*LINEAR_RUNS[::-1], *others]), root, LINEAR_SET.key)
    cfg = cmp.CompareConfig(train.TrainConfig("linear", epochs=5))
    return cmp.mean_report(cmp.compare(orders_raw(spark, sf), LINEAR_SET, LINEAR_RUNS, cfg, store=root), "linear")


VECTOR_RUNS = [*pm_grid(eps=(3.0,), modes=("categorical",), seeds=(0, 1)), *qm_grid("vectors", eps=(3.0,), n_values=(7,), seeds=(0, 1))]


# a class that no train row has
UNSEEN = 10


def _compare_softmax_sql(d: int) -> str:
    xs = X64[:d]
    vec = q.text("vec_id")
    rare = f"CASE WHEN split = 'test' AND vec_id % 17 = 0 THEN {UNSEEN} ELSE label END"
    seeds = (0, 1)
    fits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in (*xs, "label"))
    # randomised response to another class of the train labels
    noisy = [
        f"""rr{s} AS MATERIALIZED (SELECT r.* EXCLUDE (label), CASE WHEN split = 'test' THEN r.label ELSE o.v END AS label FROM
          (SELECT *, {q.u(q.h(s, 'de', vec, 'label'), 0)} AS u0, {q.u(q.h(s, 'de', vec, 'label'), 1)} AS u1 FROM raw LEFT JOIN cls ON label = v, (SELECT count(*) AS k FROM cls)) r
          LEFT JOIN cls o ON o.code = CASE WHEN u0 > exp(3.0e0) / (exp(3.0e0) + k - 1) THEN (r.code + 1 + CAST(floor(u1 * (k - 1)) AS BIGINT)) % k ELSE r.code END)"""
        for s in seeds
    ]
    copies = " UNION ALL ".join(
        [f"SELECT 0 AS exp, vec_id, split, {', '.join(xs)}, CAST(label AS DOUBLE) AS y FROM raw"]
        + [pm_copy_sql(r, n, f"rr{r.seed}", "vec_id", xs, "CAST(label AS DOUBLE)") for n, r in enumerate(VECTOR_RUNS[:2], start=1)]
    )
    fit = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in xs)
    cols = ", ".join(f"{q.minmax(c, f'lo_{c}', f'hi_{c}', -3.0, 3.0)} AS {c}" for c in xs)
    quantised = " UNION ALL ".join(
        f"SELECT {3 + s} AS exp, vec_id, split, {f} AS f, {q.minmax(c, f'lo_{c}', f'hi_{c}')} AS v, {q.u(q.h(s, 'qm', vec, c))} AS u FROM raw, lim"
        for s in seeds
        for f, c in enumerate((*xs, "label"), start=1)
    )
    keys = "exp, vec_id, split, f"
    return f"""WITH {q.qm_tables(3.0, 7, 2)}, raw AS MATERIALIZED (SELECT * REPLACE ({rare} AS label) FROM ({vectors_raw(d)})),
      lim AS MATERIALIZED (SELECT {fits} FROM raw WHERE split = 'train'),
      cls AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT label AS v FROM raw WHERE split = 'train')),
      {', '.join(noisy)},
      stacked AS MATERIALIZED ({copies}), fit AS (SELECT exp AS fexp, {fit} FROM stacked WHERE split = 'train' GROUP BY exp),
      wide AS MATERIALIZED (SELECT exp, vec_id, split, {cols}, y FROM stacked JOIN fit ON fexp = exp),
      qr AS MATERIALIZED ({quantised}), qp AS MATERIALIZED ({q.qm_probability('qr', keys, 7)}),
      qs AS MATERIALIZED ({q.qm_sample('qr', keys, 7)}),
      qa AS (SELECT {keys}, CAST(min(pos) - 3 AS INTEGER) AS idx FROM (SELECT *, max(p) OVER (PARTITION BY {keys}) AS best FROM qp) WHERE p = best GROUP BY {keys}),
      allx AS MATERIALIZED ({ts.long_x('wide', 'vec_id', xs)} UNION ALL SELECT exp, vec_id, f, CAST(idx AS DOUBLE) FROM qs WHERE f <= {d} AND split = 'train'
        UNION ALL SELECT exp, vec_id, f, CAST(idx AS DOUBLE) FROM qa WHERE f <= {d} AND split = 'test'
        UNION ALL SELECT 3 + s, vec_id, 0, 1.0e0 FROM raw, (VALUES (0), (1)) AS s(s)),
      labels AS MATERIALIZED (SELECT exp, vec_id AS id, split, y FROM wide UNION ALL
        SELECT exp, vec_id, split, (idx + 3) / 6.0e0 * (hi_label - lo_label) + lo_label FROM qs, lim WHERE f = {d + 1} AND split = 'train'),
      cc AS MATERIALIZED (SELECT exp, v, CAST(row_number() OVER (PARTITION BY exp ORDER BY v) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT exp, y AS v FROM labels WHERE split = 'train')),
      y AS MATERIALIZED (SELECT l.exp, l.id, cc.c, CASE WHEN l.y = cc.v THEN 1.0e0 ELSE 0.0e0 END AS y FROM labels l JOIN cc ON cc.exp = l.exp WHERE split = 'train'),
      x AS MATERIALIZED (SELECT a.* FROM allx a SEMI JOIN (SELECT vec_id AS id FROM raw WHERE split = 'train') t ON t.id = a.id),
      tx AS MATERIALIZED (SELECT a.* FROM allx a SEMI JOIN (SELECT vec_id AS id FROM raw WHERE split = 'test') t ON t.id = a.id),
      {ts.train_ctes('softmax', 3)},
      truth AS (SELECT vec_id AS id, coalesce(code, -1) AS t FROM raw LEFT JOIN cls ON label = v WHERE split = 'test'),
      pr AS MATERIALIZED (SELECT p.exp, p.id, p.c, p.p, t.t FROM ({ts.predictions('softmax', 'beta_3', 'tx')}) p JOIN truth t ON t.id = p.id WHERE p.exp > 0 OR t.t <> -1),
      best AS (SELECT exp, id, min(t) AS t, arg_max(c, (p, -c)) AS pred FROM pr GROUP BY exp, id),
      ac AS (SELECT exp, avg(CASE WHEN pred = t THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM best GROUP BY exp),
      sc AS (SELECT exp, c, round(p, 12) AS score, CASE WHEN t = c THEN 1 ELSE 0 END AS y FROM pr),
      au AS (SELECT exp, avg(auc) AS auc FROM ({ts.auc_sql('sc', 'exp, c')}) GROUP BY exp),
      one AS (SELECT ac.exp, round_even(acc, 3) AS acc, round_even(auc, 3) AS auc FROM ac JOIN au ON au.exp = ac.exp),
      named AS (SELECT CASE WHEN exp <= 2 THEN 'categorical' ELSE 'linear' END AS mode, CASE WHEN exp <= 2 THEN 'LDP-PM(T3)' ELSE 'LDP-QM' END AS variant, acc, auc FROM one WHERE exp > 0
        UNION ALL SELECT mode, 'Full', acc, auc FROM one, (VALUES ('categorical'), ('linear')) AS m(mode) WHERE exp = 0)
    SELECT 'vectors' AS dataset, 3.0e0 AS eps, 3.0e0 AS label_eps, mode, variant, round(avg(acc), 4) AS "Accuracy", round(avg(auc), 4) AS "AUC_macro" FROM named GROUP BY mode, variant"""


def _compare_softmax(spark, sf, d: int):
    vectors = vector_table(spark, sf, d)
    unseen = (F.col("split") == "test") & (F.col("vec_id") % 17 == 0)
    vectors = vectors.withColumn("label", F.when(unseen, F.lit(UNSEEN)).otherwise(F.col("label"))).drop("split")
    cfg = cmp.CompareConfig(train.TrainConfig("softmax", epochs=3))
    scores = cmp.compare(vectors, Dataset("vectors", ("vec_id",), "label", X64[:d]), VECTOR_RUNS, cfg)
    keys = ["dataset", "eps", "label_eps", "mode", "variant"]
    means = scores.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("value"))
    return evaluate.wide_report(means, ["Accuracy", "AUC_macro"], keys)


@query("compare_softmax", _compare_softmax_sql(4))
def compare_softmax(spark, sf):
    """Randomised response and quantised labels against raw ones: ten classes, and one class that only test rows have.
    Raw models leave its rows out, private ones count them as wrong."""
    return _compare_softmax(spark, sf, 4)


@query("compare_softmax_wide", _compare_softmax_sql(64))
def compare_softmax_wide(spark, sf):
    """The same on all 64 features."""
    return _compare_softmax(spark, sf, 64)


# ---------------------------------------------------------------- scoring


def _score_linear_sql() -> str:
    feats = ("day", "o_custkey")
    return f"""WITH {q.qm_tables(1.0, 6, 3)}, {ORDERS_DATA}, lim AS (SELECT min(price) AS lo, max(price) AS hi FROM raw WHERE split = 'train'),
      r AS (SELECT o_orderkey, {q.minmax('price', 'lo', 'hi')} AS v, {q.u(q.h(0, 'qm', ORDER, 'price'))} AS u FROM raw, lim WHERE split = 'train'),
      s AS ({q.qm_sample('r', 'o_orderkey', 6)}),
      x AS MATERIALIZED ({ts.long_x('data', 'o_orderkey', feats, "split = 'train'")}), y AS MATERIALIZED (SELECT 0 AS exp, o_orderkey AS id, 0 AS c, CAST(idx AS DOUBLE) AS y FROM s),
      {ts.train_ctes('linear', 5)}, tx AS ({ts.long_x('data', 'o_orderkey', feats, "split = 'test'")})
    SELECT id AS o_orderkey, round(z, 7) AS pred_index, round((greatest(least(z, 3), -3) + 3) / 6.0e0 * (hi - lo) + lo, 7) AS pred FROM ({ts.predictions('linear', 'beta_5', 'tx')}), lim"""


@query("score_linear", _score_linear_sql())
def score_linear(spark, sf):
    """Train on quantised labels, predict test rows, map predictions back to the label range."""
    from ldpspark.functions import quantised
    from ldpspark.sources.catalog import design_mechanisms

    features = ["day", "o_custkey"]
    rows = order_data(spark, sf)
    s = scale.fit(rows, ["y"], where=is_train())["y"]
    m = design_mechanisms(spark, [("avg", 1.0, 6)])[("avg", 1.0, 6)]
    from ldpspark.functions.layers import project

    noisy = project(
        rows.where(is_train()),
        [quantised.sample("y", privatise.scaled("y", s), quantised.Lookup([m]), row_key("o_orderkey"), 0, "price")],
    )
    betas = train.train_linear(noisy, features, "y", train.TrainConfig("linear", epochs=5))
    scored = score.predict_linear(rows.where(~is_train()), features, betas)
    inverted = score.invert_label(F.col("pred"), *m.index_range, s.min, s.max)
    return scored.select("o_orderkey", F.round("pred", 7).alias("pred_index"), F.round(inverted, 7).alias("pred"))


@query(
    "score_logistic",
    f"""WITH {DOCS_DATA}, {train_xy('doc_id', ('n_chars', 'words'))}, {ts.train_ctes('logistic', 2)},
      tx AS ({ts.long_x('data', 'doc_id', ('n_chars', 'words'), "split = 'test'")})
    SELECT id AS doc_id, round(p, 8) AS prob FROM ({ts.predictions('logistic', 'beta_2', 'tx')})""",
)
def score_logistic(spark, sf):
    features = ["n_chars", "words"]
    rows = docs_data(spark, sf)
    betas = train.train_logistic(rows.where(is_train()), features, "y", train.TrainConfig("logistic", epochs=2))
    return score.predict_logistic(rows.where(~is_train()), features, betas).select("doc_id", F.round("prob", 8).alias("prob"))


def _score_softmax_sql(d: int) -> str:
    xs = X64[:d]
    return f"""WITH {scaled_sql(vectors_raw(d), 'vec_id', xs, 'label')}, {train_xy('vec_id', xs, class_y(10))}, {ts.train_ctes('softmax', 2)},
      tx AS ({ts.long_x('data', 'vec_id', xs, "split = 'test'")}), pr AS MATERIALIZED ({ts.predictions('softmax', 'beta_2', 'tx')}),
      mx AS (SELECT id, max(p) AS pm FROM pr GROUP BY id)
    SELECT pr.id AS vec_id, CAST(min(CASE WHEN p = pm THEN c END) AS INTEGER) AS pred, {', '.join(f'round(max(CASE WHEN c = {c} THEN p END), 8) AS prob{c}' for c in range(10))}
    FROM pr JOIN mx ON mx.id = pr.id GROUP BY pr.id"""


def _score_softmax(spark, sf, d: int):
    rows = vector_data(spark, sf, d)
    betas = train.train_softmax(rows.where(is_train()), list(X64[:d]), "y", train.TrainConfig("softmax", epochs=2))
    out = score.predict_softmax(rows.where(~is_train()), list(X64[:d]), betas)
    return out.select("vec_id", "pred", *[F.round(f"prob{c}", 8).alias(f"prob{c}") for c in range(10)])


@query("score_softmax", _score_softmax_sql(4))
def score_softmax(spark, sf):
    return _score_softmax(spark, sf, 4)


@query("score_softmax_wide", _score_softmax_sql(64))
def score_softmax_wide(spark, sf):
    """The same on all 64 dimensions, scored per Arrow batch."""
    return _score_softmax(spark, sf, 64)


# ---------------------------------------------------------------- evaluation


@query(
    "rmse_mae",
    f"""SELECT o_orderstatus, round(sqrt(avg((o_totalprice - (200000.0e0 + 3 * {DAY})) * (o_totalprice - (200000.0e0 + 3 * {DAY})))), 3) AS rmse,
      round(avg(abs(o_totalprice - (200000.0e0 + 3 * {DAY}))), 3) AS mae FROM orders GROUP BY o_orderstatus""",
)
def rmse_mae(spark, sf):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", (F.lit(200000.0) + 3 * day).alias("pred"))
    out = evaluate.rmse_mae(orders, "o_totalprice", "pred", ["o_orderstatus"])
    return out.select("o_orderstatus", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query(
    "accuracy",
    f"""WITH c AS (SELECT event_type AS v, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)),
      n AS (SELECT event_id, event_type, code, {noise_columns(0, 'de', EVENT, 'event_type')} FROM events JOIN c ON event_type = v)
    SELECT event_type, round(avg(CASE WHEN (CASE WHEN u0 > {q.d(2.718281828459045 ** 2 / (2.718281828459045 ** 2 + 4))} THEN CAST(floor(u1 * 5) AS BIGINT) ELSE code END) = code THEN 1.0e0 ELSE 0.0e0 END), 9) AS accuracy
    FROM n GROUP BY event_type""",
)
def accuracy(spark, sf):
    """How often a perturbed category equals the true one."""
    events = table(spark, sf, "events").select("event_id", "event_type")
    cats = encode.categories(events, "event_type")
    noisy = privatise.respond(events, "event_type", cats, 2.0, row_key("event_id"), 0, mode="all", output="noisy")
    out = evaluate.accuracy(noisy, "event_type", "noisy", ["event_type"])
    return out.select("event_type", F.round("accuracy", 9).alias("accuracy"))


AUC_ROWS = "SELECT l_linestatus, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, l_extendedprice / 200000.0e0 AS score FROM lineitem"
TIED_ROWS = "SELECT l_linestatus, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, l_quantity / 50.0e0 AS score FROM lineitem"


def auc_rows(spark, sf, column: str, divisor: float):
    return table(spark, sf, "lineitem").select(
        "l_linestatus", F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("y"), (F.col(column) / divisor).alias("score")
    )


@query("auc", f"WITH r AS ({AUC_ROWS}) SELECT round(auc, 9) AS auc FROM ({ts.auc_sql('r')})")
def auc(spark, sf):
    return evaluate.auc(auc_rows(spark, sf, "l_extendedprice", 200000.0), "y", "score").select(F.round("auc", 9).alias("auc"))


@query(
    "auc_tied", f"WITH r AS ({TIED_ROWS}) SELECT l_linestatus, round(auc, 9) AS auc FROM ({ts.auc_sql('r', 'l_linestatus')})"
)
def auc_tied(spark, sf):
    out = evaluate.auc(auc_rows(spark, sf, "l_quantity", 50.0), "y", "score", ["l_linestatus"])
    return out.select("l_linestatus", F.round("auc", 9).alias("auc"))


@query(
    "roc_points",
    f"WITH r AS ({TIED_ROWS}) SELECT l_linestatus, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM ({ts.roc_sql('r', 'l_linestatus')})",
)
def roc_points(spark, sf):
    out = evaluate.roc_points(auc_rows(spark, sf, "l_quantity", 50.0), "y", "score", ["l_linestatus"])
    return out.select("l_linestatus", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    "youden",
    f"WITH r AS ({AUC_ROWS}) SELECT l_linestatus, threshold, round(youden_j, 9) AS youden_j FROM ({ts.youden_sql('r', 'l_linestatus')})",
)
def youden(spark, sf):
    out = evaluate.youden(auc_rows(spark, sf, "l_extendedprice", 200000.0), "y", "score", ["l_linestatus"])
    return out.select("l_linestatus", "threshold", F.round("youden_j", 9).alias("youden_j"))


@query(
    "binary_report",
    f"""WITH r AS ({TIED_ROWS}), yo AS ({ts.youden_sql('r', 'l_linestatus')}), au AS ({ts.auc_sql('r', 'l_linestatus')})
    SELECT r.l_linestatus, round(avg(CASE WHEN (score >= threshold) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END), 9) AS accuracy, round(min(au.auc), 9) AS auc
    FROM r JOIN yo ON yo.l_linestatus = r.l_linestatus JOIN au ON au.l_linestatus = r.l_linestatus GROUP BY r.l_linestatus""",
)
def binary_report(spark, sf):
    """Accuracy at the best threshold, with the AUC."""
    out = evaluate.binary_report(auc_rows(spark, sf, "l_quantity", 50.0), "y", "score", ["l_linestatus"])
    return out.select("l_linestatus", F.round("accuracy", 9).alias("accuracy"), F.round("auc", 9).alias("auc"))


_TYPES = 6


def _class_rows_sql() -> str:
    score_of = ", ".join(
        f"{q.u(q.h(9, 'score', PART, f'class{c}'))} + CASE WHEN code = {c} THEN 0.3e0 ELSE 0.0e0 END AS prob{c}" for c in range(_TYPES)
    )
    return f"""c AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
      r AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN -1 ELSE code END AS truth, {score_of} FROM part JOIN c ON p_type = v),
      l AS ({' UNION ALL '.join(f'SELECT {c} AS class, CASE WHEN truth = {c} THEN 1 ELSE 0 END AS y, prob{c} AS score FROM r WHERE truth <> -1' for c in range(_TYPES))})"""


def class_rows(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    coded = encode.ordinal_encode(part, "p_type", encode.categories(part, "p_type"), "code")
    key = row_key("p_partkey")
    scores = {
        f"prob{c}": uniform(9, "score", key, f"class{c}") + F.when(F.col("code") == c, 0.3).otherwise(0.0) for c in range(_TYPES)
    }
    return coded.withColumns(scores).withColumn("truth", F.when(F.col("p_size") > 45, -1).otherwise(F.col("code")))


@query("class_auc", f"WITH {_class_rows_sql()} SELECT class, round(auc, 9) AS auc FROM ({ts.auc_sql('l', 'class')})")
def class_auc(spark, sf):
    rows = class_rows(spark, sf).where(F.col("truth") != -1)
    return evaluate.class_auc(rows, "truth", _TYPES).select("class", F.round("auc", 9).alias("auc"))


@query("macro_auc", f"WITH {_class_rows_sql()} SELECT round(avg(auc), 9) AS auc_macro FROM ({ts.auc_sql('l', 'class')})")
def macro_auc(spark, sf):
    return evaluate.macro_auc(class_rows(spark, sf), "truth", _TYPES).select(F.round("auc_macro", 9).alias("auc_macro"))


# ---------------------------------------------------------------- reports

SCORE_ROWS = """SELECT CASE o_orderstatus WHEN 'F' THEN 'Full' WHEN 'O' THEN 'LDP-PM(T3)' ELSE 'LDP-QM' END AS variant, o_orderkey % 7 AS seed,
        round_even(sqrt(avg(o_totalprice * o_totalprice)) / 1e5, 3) AS rmse, round_even(avg(o_totalprice) / 1e5, 3) AS mae FROM orders GROUP BY 1, 2"""


def score_rows(spark, sf):
    """Long scores of seven seeds and three variants, made from the orders."""
    orders = table(spark, sf, "orders")
    mechanism = F.when(F.col("o_orderstatus") == "F", "raw").when(F.col("o_orderstatus") == "O", "pm_t3").otherwise("qm")
    wide = (
        orders.withColumn("mechanism", mechanism)
        .withColumn("variant", evaluate.variant_column())
        .groupBy("variant", (F.col("o_orderkey") % 7).alias("seed"))
        .agg(
            (F.sqrt(F.avg(F.col("o_totalprice") * F.col("o_totalprice"))) / 1e5).alias("rmse"),
            (F.avg("o_totalprice") / 1e5).alias("mae"),
        )
    )
    return evaluate.stack_metrics(wide, ["variant", "seed"], {"rmse": "RMSE", "mae": "MAE"})


@query(
    "seed_mean",
    f"""WITH s AS ({SCORE_ROWS}) SELECT variant, round_even(avg(rmse), 3) AS "RMSE", round_even(avg(mae), 3) AS "MAE" FROM s GROUP BY variant ORDER BY variant""",
)
def seed_mean(spark, sf):
    return evaluate.wide_report(evaluate.seed_means(score_rows(spark, sf)), ["RMSE", "MAE"])


# ---------------------------------------------------------------- privatisation grids

PART_SET = Dataset("part", ("p_partkey",), "p_type", ("p_size", "p_retailprice"))
PART_RUNS = pm_grid(eps=(1.0, 3.0), t=(2.0, 3.0), modes=("categorical",), seeds=(0, 1))


def _pm_grid_sql() -> str:
    raw = f"SELECT p_partkey, {q.split(PART)} AS split, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_type FROM part"
    runs = []
    for n, r in enumerate(PART_RUNS):
        copy = pm_copy_sql(r, n, "raw", "p_partkey", ("p_size", "p_retailprice"), "p_type")
        keep = q.d(2.718281828459045**r.eps / (2.718281828459045**r.eps + 5))
        runs.append(
            f"""SELECT {n} AS run, {q.d(r.eps)} AS eps, {q.d(r.t)} AS t, {r.seed} AS seed, d.split, d.p_partkey, round(d.p_size, 6) AS p_size, round(d.p_retailprice, 6) AS p_retailprice,
        CASE WHEN d.split = 'test' THEN d.y ELSE c2.v END AS p_type FROM (SELECT *, {noise_columns(r.seed, 'de', PART, 'p_type')} FROM ({copy})) d
        JOIN cats c1 ON c1.v = d.y JOIN cats c2 ON c2.code = CASE WHEN d.u0 > {keep} THEN (c1.code + 1 + CAST(floor(d.u1 * 5) AS BIGINT)) % 6 ELSE c1.code END"""
        )
    return f"""WITH raw AS MATERIALIZED ({raw}), cats AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM raw WHERE split = 'train'))
    {' UNION ALL '.join(runs)}"""


@query("privacy_grid_pm", _pm_grid_sql())
def privacy_grid_pm(spark, sf):
    """Two variants, two budgets, two seeds; labels by strict randomised response; one pass."""
    prepared = prepare(table(spark, sf, "part"), PART_SET)
    out = privatise_runs(prepared, fit_dataset(prepared, PART_SET, categorical_label=True), PART_RUNS)
    return out.select(
        "run", "eps", "t", "seed", "split", "p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"), "p_type"
    )


CUST_SET = Dataset("orders", ("o_orderkey",), "o_custkey", ("o_totalprice",))
CUST_RUNS = qm_grid("orders", eps=(1.0, 3.0), n_values=(7,), seeds=(0, 1))
# widths of the best average-case mechanisms: eps 1 -> 3, eps 3 -> 2
_WIDTH_OF = {1.0: 3, 3.0: 2}


def _qm_grid_sql(grid, n_outputs: int, widths: dict[float, int]) -> str:
    half = n_outputs // 2
    shift = f"min(pos) - {half}" if n_outputs % 2 else f"min(CASE WHEN pos < {half} THEN pos - {half} ELSE pos - {half} + 1 END)"
    raw = f"SELECT o_orderkey, {q.split(ORDER)} AS split, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders"
    ctes = [q.qm_tables(e, n_outputs, c, f"q{int(e)}") for e, c in widths.items()]
    runs = []
    for n, r in enumerate(grid):
        name = f"q{int(r.eps)}"
        for c in ("o_totalprice", "o_custkey"):
            where = "TRUE" if c == "o_totalprice" else "split = 'train'"
            ctes.append(
                f"r{n}_{c} AS MATERIALIZED (SELECT o_orderkey, split, {q.minmax(c, f'lo_{c}', f'hi_{c}')} AS v, {q.u(q.h(r.seed, 'qm', ORDER, c))} AS u FROM raw, lim WHERE {where})"
            )
            ctes.append(f"s{n}_{c} AS ({q.qm_sample(f'r{n}_{c}', 'o_orderkey, split', n_outputs, name)})")
        ctes.append(
            f"""a{n} AS (SELECT o_orderkey, CAST({shift} AS INTEGER) AS idx FROM (SELECT *, max(p) OVER (PARTITION BY o_orderkey) AS best
          FROM ({q.qm_probability(f'(SELECT * FROM r{n}_o_totalprice WHERE split = $$test$$)', 'o_orderkey', n_outputs, name)})) WHERE p = best GROUP BY o_orderkey)"""
        )
        runs.append(
            f"""SELECT {n} AS run, {q.d(r.eps)} AS eps, {r.seed} AS seed, w.split, w.o_orderkey, CAST(CASE WHEN w.split = 'test' THEN a.idx ELSE f.idx END AS DOUBLE) AS o_totalprice,
        CASE WHEN w.split = 'test' THEN w.o_custkey ELSE round((l.idx + {half}) / {q.d(2 * half)} * (hi_o_custkey - lo_o_custkey) + lo_o_custkey, 6) END AS o_custkey
        FROM raw w CROSS JOIN lim LEFT JOIN s{n}_o_totalprice f ON f.o_orderkey = w.o_orderkey LEFT JOIN a{n} a ON a.o_orderkey = w.o_orderkey LEFT JOIN s{n}_o_custkey l ON l.o_orderkey = w.o_orderkey"""
        )
    lim = "SELECT min(o_totalprice) AS lo_o_totalprice, max(o_totalprice) AS hi_o_totalprice, min(o_custkey) AS lo_o_custkey, max(o_custkey) AS hi_o_custkey FROM raw WHERE split = 'train'"
    return f"WITH raw AS MATERIALIZED ({raw}), lim AS ({lim}), {', '.join(ctes)} {' UNION ALL '.join(runs)}"


@query("privacy_grid_qm", _qm_grid_sql(CUST_RUNS, 7, _WIDTH_OF))
def privacy_grid_qm(spark, sf):
    """Quantised features and linearly mapped labels, two budgets, two seeds; one pass."""
    prepared = prepare(wide_table(spark, sf, "orders"), CUST_SET)
    out = privatise_runs(prepared, fit_dataset(prepared, CUST_SET), CUST_RUNS)
    return out.select("run", "eps", "seed", "split", "o_orderkey", "o_totalprice", F.round("o_custkey", 6).alias("o_custkey"))


WIDE_RUNS = qm_grid("orders", eps=(1.0, 3.0), n_values=(64,), seeds=(0,))


@query("qm_wide_grid", _qm_grid_sql(WIDE_RUNS, 64, {1.0: 27, 3.0: 17}))
def qm_wide_grid(spark, sf):
    """Features and labels of 64 outputs, two budgets."""
    prepared = prepare(wide_table(spark, sf, "orders"), CUST_SET)
    out = privatise_runs(prepared, fit_dataset(prepared, CUST_SET), WIDE_RUNS)
    return out.select("run", "eps", "seed", "split", "o_orderkey", "o_totalprice", F.round("o_custkey", 6).alias("o_custkey"))
