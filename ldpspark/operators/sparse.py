"""Gradient descent over categories in sparse form: a coefficient per category, but no column and no list of them.

A row has dense features, held as columns, and cells ``(row key, column, code)``, one for each known category
(``one_hot_sparse``). Coefficients of categories are a table ``(exp, column, code, beta)`` that stays in Spark; the bias
and the dense coefficients are few and live on the driver, as in ``train``.

The rows do not move after they are laid out. Cells are kept twice, once beside their coefficients and once beside their
rows. A step sends the coefficients to the first copy, products (a key and a number a cell) to the rows, errors to the
second copy, and sums per category back. A category may fill any share of the rows: its cells are dealt over ``SALTS``
places, each of which gets its coefficient, and sums are taken before they are sent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activations import dot, sigmoid
from ..functions.params import double_array
from ..session import settle
from .encode import Categories, one_hot_sparse
from .profile import quoted
from .train import TrainConfig, drop_failed, gaps_as_null, starts, with_coefficients, with_model

# places over which the cells of one category are dealt
SALTS = 32

CODE = ["exp", "column", "code"]


@dataclass
class SparseModels:
    """``dense[exp]`` holds the bias and the dense coefficients, ``table`` those of the categories."""

    dense: dict[int, np.ndarray]
    table: DataFrame


def train_sparse(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    columns: Sequence[str],
    fitted: dict[str, Categories],
    label: str,
    cfg: TrainConfig,
) -> SparseModels:
    """Full-batch linear or logistic regression on ``features`` and the categories of ``columns``.

    The result is that of ``train`` on the one-hot columns of ``fitted``: a NULL or unknown category has no cell, which
    is zero in all its columns; missing numbers and labels count as there. ``key`` must be unique within a model: it ties
    cells to rows, and rows that repeat a key would be given each other's cells. A category without rows in ``df`` keeps
    no coefficient, which scores as zero. A model whose sums are not finite is left out of both parts of the result.
    """
    if cfg.model not in ("linear", "logistic"):
        raise ValueError(f"no sparse form of {cfg.model}")
    if cfg.batch_size > 0:
        raise ValueError("sparse training takes full batches")
    df, key, features = with_model(df), list(key), list(features)
    tied = [f"__k{n}" for n in range(len(key))]
    df = gaps_as_null(df, [*features, label])
    named = df.select("exp", *[quoted(c).alias(t) for c, t in zip(key, tied)], *[quoted(c) for c in dict.fromkeys([*features, label, *columns])])
    ids = ["exp", *tied]
    rows = named.select(*ids, *[quoted(c).alias(f"__x{n}") for n, c in enumerate(features)], quoted(label).cast("double").alias("__y"))
    cells = one_hot_sparse(named, ids, columns, fitted)
    betas, _ = starts(df, label, cfg.model, len(features), missing_is_zero=cfg.model == "linear")

    salt = F.pmod(F.xxhash64(*tied), F.lit(SALTS)).cast("int").alias("__salt")
    kept = [
        rows.repartition(*ids).persist(StorageLevel.MEMORY_AND_DISK),
        cells.repartition(*ids).persist(StorageLevel.MEMORY_AND_DISK),
        cells.select("*", salt).repartition(*CODE, "__salt").persist(StorageLevel.MEMORY_AND_DISK),
    ]
    try:
        table = settle(kept[1].select(*CODE).distinct().withColumn("beta", F.lit(0.0)))
        for _ in range(cfg.epochs):
            table = _step(*kept, table, betas, ids, len(features), cfg)
    finally:
        for part in kept:
            part.unpersist()
    return SparseModels(betas, table.where(F.col("exp").isin(list(betas))))


def _products(cells: DataFrame, table: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The sum of a row's category coefficients; ``cells`` carry ``__salt``."""
    places = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cells.join(places, [*CODE, "__salt"]).groupBy(*ids).agg(F.sum("beta").alias("__s"))


def _errors(rows: DataFrame, sums: DataFrame, betas, ids: Sequence[str], d: int, model: str) -> DataFrame:
    xs = [F.col(f"__x{n}") for n in range(d)]
    joined = rows.join(sums, list(ids), "left").where(F.col("exp").isin(list(betas)))
    y = F.col("__y")
    if model == "linear":
        # moments skip each product that lacks a cell, as if the cell were zero
        xs, y = [F.coalesce(x, F.lit(0.0)) for x in xs], F.coalesce(y, F.lit(0.0))
    ready, b = with_coefficients(joined, betas, d + 1)
    z = dot(xs, [b(n + 1) for n in range(d)], b(0)) + F.coalesce("__s", F.lit(0.0))
    error = (sigmoid(z) if model == "logistic" else z) - y
    return ready.select(*ids, *[x.alias(f"__x{n}") for n, x in enumerate(xs)], error.alias("__e"))


def _step(rows, row_cells, code_cells, table, betas, ids, d: int, cfg: TrainConfig) -> DataFrame:
    """Move ``betas`` in place; give the moved table."""
    if not betas:
        return table
    factor = 2.0 if cfg.model == "linear" else 1.0
    errors = _errors(rows, _products(code_cells, table, ids), betas, ids, d, cfg.model).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = [F.sum("__e")] + [F.sum(F.col("__e") * F.col(f"__x{n}")) for n in range(d)]
        totals = errors.groupBy("exp").agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"g{n}") for n, s in enumerate(sums)]).collect()
        size = {r["exp"]: r["n"] for r in totals}
        by_code = row_cells.join(errors.select(*ids, "__e"), list(ids)).groupBy(*CODE).agg(F.sum("__e").alias("__g"))
        # a category whose rows all lack a number keeps a sum of nothing, which is zero
        slope = F.coalesce("__g", F.lit(0.0)) * factor / _of(size) + F.lit(factor * cfg.regularization) * F.col("beta")
        known = table.where(F.col("exp").isin(list(size)))
        graded = settle(known.join(by_code, CODE, "left").select(*CODE, "beta", slope.alias("__g")))
    finally:
        errors.unpersist()

    squares = {r["exp"]: r["q"] for r in graded.groupBy("exp").agg(F.sum(F.col("__g") * F.col("__g")).alias("q")).collect()}
    shrink = {}
    for row in totals:
        exp, beta = row["exp"], betas[row["exp"]]
        ridge = factor * cfg.regularization * beta
        ridge[0] = 0.0
        gradient = np.array([row[f"g{n}"] or 0.0 for n in range(d + 1)]) * factor / row["n"] + ridge
        square = float(gradient @ gradient) + (squares.get(exp) or 0.0)
        if drop_failed(betas, exp, gradient, square):
            continue
        norm = math.sqrt(square)
        shrink[exp] = cfg.gradient_clip / norm if norm > cfg.gradient_clip else 1.0
        betas[exp] = np.clip(beta - cfg.learning_rate * shrink[exp] * gradient, -cfg.parameter_clip, cfg.parameter_clip)
    if not shrink:
        return graded.select(*CODE, "beta").limit(0)
    moved = F.col("beta") - F.lit(cfg.learning_rate) * _of(shrink) * F.col("__g")
    limited = F.greatest(F.least(moved, F.lit(float(cfg.parameter_clip))), F.lit(-float(cfg.parameter_clip)))
    return graded.where(F.col("exp").isin(list(shrink))).select(*CODE, limited.alias("beta"))


def _of(values: dict[int, float]) -> Column:
    """The number of the row's model."""
    listed = [float(values.get(n, 1.0)) for n in range(max(values, default=0) + 1)]
    return F.get(double_array(listed), F.col("exp").cast("int"))


def score_sparse(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    columns: Sequence[str],
    fitted: dict[str, Categories],
    models: SparseModels,
    model: str,
    output: str = "prediction",
) -> DataFrame:
    """Add the linear score or the probability. A row of a model that has no coefficients, or with a missing number, gets
    NULL; categories that the model does not know count as zero."""
    df, key = with_model(df), list(key)
    if not models.dense:
        return df.withColumn(output, F.lit(None).cast("double"))
    ids = ["exp", *key]
    cells = one_hot_sparse(df, ids, columns, fitted)
    salt = F.pmod(F.xxhash64(*[quoted(c) for c in key]), F.lit(SALTS)).cast("int").alias("__salt")
    sums = _products(cells.select("*", salt), models.table, ids)
    joined = gaps_as_null(df, features).join(sums, ids, "left")
    known = F.col("exp").isin(list(models.dense))
    ready, b = with_coefficients(joined, models.dense, len(features) + 1)
    z = dot([quoted(c) for c in features], [b(n + 1) for n in range(len(features))], b(0)) + F.coalesce("__s", F.lit(0.0))
    value = F.when(known, sigmoid(z) if model == "logistic" else z)
    return ready.select(*[quoted(c) for c in df.columns], value.alias(output))
