"""Scoring: predictions of many models in one projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.activations import Z_LIMIT, clip, dot, first_argmax, sigmoid
from .profile import quoted
from .train import MAX_SOFTMAX_AGGREGATES, add_softmax, with_coefficients, with_model


def predict_linear(df: DataFrame, features: Sequence[str], betas: dict[int, np.ndarray], output: str = "pred"):
    ready, b = with_coefficients(with_model(df), betas, len(features) + 1)
    z = dot([quoted(c) for c in features], [b(k + 1) for k in range(len(features))], b(0))
    return ready.withColumn(output, z).drop("__b")


def predict_logistic(df: DataFrame, features: Sequence[str], betas: dict[int, np.ndarray], output: str = "prob"):
    scored = predict_linear(df, features, betas, "__z")
    return scored.withColumn(output, sigmoid(F.col("__z"))).drop("__z")


def predict_softmax(df: DataFrame, features: Sequence[str], betas: dict[int, np.ndarray], prefix: str = "prob"):
    """Class probabilities ``prefix0`` .. and ``pred``: the first class that reaches the maximum.

    Small models are unrolled to expressions. Wide ones would leave compiled code, and are a matrix product per Arrow
    batch. A row with a missing feature, or of a model without coefficients, has no probabilities and no prediction.
    """
    k = next(iter(betas.values())).shape[1]
    if (len(features) + 1) * k > MAX_SOFTMAX_AGGREGATES:
        return _matrix_softmax(with_model(df), list(features), betas, k, prefix)
    scored = add_softmax(with_model(df), features, betas, k)
    pred = first_argmax([F.col(f"__p{c}") for c in range(k)], F.col("__pmax"))
    named = scored.withColumn("pred", pred)
    for_class = [F.col(f"__p{c}").alias(f"{prefix}{c}") for c in range(k)]
    return named.select(*[quoted(c) for c in df.columns], *([] if "exp" in df.columns else ["exp"]), *for_class, "pred")


def _matrix_softmax(df: DataFrame, features: list[str], betas: dict[int, np.ndarray], k: int, prefix: str) -> DataFrame:
    def probabilities(batch: pa.RecordBatch) -> np.ndarray:
        cells = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features]
        x = np.column_stack([np.ones(batch.num_rows), *cells])
        exp = batch.column("exp").to_numpy(zero_copy_only=False)
        p = np.full((batch.num_rows, k), np.nan)
        for model, beta in betas.items():
            of = exp == model
            # feature by feature: a matrix product may round equal rows differently, which would break ties
            z = np.zeros((int(of.sum()), k))
            for column, weights in zip(x[of].T, beta):
                z += column[:, None] * weights
            z = np.clip(z, -Z_LIMIT, Z_LIMIT)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p[of] = e / e.sum(axis=1, keepdims=True)
        return p

    def run(batches):
        for batch in batches:
            p = probabilities(batch)
            whole = ~np.isnan(p).any(axis=1)
            best = pa.array(np.where(whole, np.where(whole[:, None], p, 0.0).argmax(axis=1), 0), pa.int32(), mask=~whole)
            added = [pa.array(p[:, c], mask=~whole) for c in range(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added, best], names)

    names = [*df.columns, *[f"{prefix}{c}" for c in range(k)], "pred"]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names[len(df.columns) : -1]], T.StructField("pred", T.IntegerType())])
    return df.mapInArrow(run, schema)


def invert_label(pred: Column, index_min, index_max, label_min, label_max) -> Column:
    """Predicted LDP index to the label range: clip to the index range, then map linearly.

    The bounds may be columns; NULL bounds mean that there is nothing to invert.
    """
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (index_min, index_max))
    to_lo, to_hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (label_min, label_max))
    inside = clip(pred, lo, hi)
    mapped = (inside - lo) / F.nullif(hi - lo, F.lit(0.0)) * (to_hi - to_lo) + to_lo
    narrow = (hi - lo) <= 1e-9
    return F.when(lo.isNull(), pred).when(narrow, F.when(pred.isNotNull(), to_lo)).otherwise(mapped)


