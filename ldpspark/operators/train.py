"""Gradient descent for linear, logistic and softmax regression, many models at once.

Training rows are ``(exp, <features>, y)`` with an integer model number ``exp``. One grouped aggregate per step
gives the gradients of all models; only the gradients (models x parameters) reach the driver, the rows stay
on the executors. Coefficients go back as array literals, so every step runs the same compiled code.

Linear full-batch training needs a single pass: the moments X'X and X'y carry everything the steps use.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activations import Z_LIMIT, clip, dot, sigmoid
from ..functions.params import Table
from ..functions.permute import constants
from ..session import settle
from .encode import PRIOR_FLOOR
from .profile import quoted
from .split import assign_batches, hash_ranks, in_batches

logger = logging.getLogger(__name__)

MODELS = ("linear", "logistic", "softmax")
ORDERS = ("hash", "permuted")

# More aggregates than this in one job leave compiled code; beyond it, partitions compute their partial
# sums with numpy and Spark adds them up.
MAX_AGGREGATES = 300

# Softmax gradients are a matrix product; numpy wins early.
MAX_SOFTMAX_AGGREGATES = 24


@dataclass(frozen=True)
class TrainConfig:
    model: str = "logistic"
    learning_rate: float = 0.05
    epochs: int = 10
    regularization: float = 0.1
    batch_size: int = -1
    gradient_clip: float = 1.0
    parameter_clip: float = 1.0
    seed: int = 0
    # mini-batch steps are sequential; if this is set, more steps are refused with an explanation
    max_steps: int | None = None
    # how an epoch orders its rows: by the epoch's own hash, or by a permutation of one rank, which is found once
    order: str = "hash"

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"unknown model: {self.model}")
        if self.order not in ORDERS:
            raise ValueError(f"unknown order: {self.order}")


def descend(beta: np.ndarray, gradient: np.ndarray, cfg: TrainConfig) -> np.ndarray:
    """One step for one model; row 0 of ``beta`` is the bias. Norm clip, step, parameter clip."""
    norm = float(np.sqrt(np.sum(gradient * gradient)))
    if norm > cfg.gradient_clip:
        gradient = gradient * cfg.gradient_clip / norm
    return np.clip(beta - cfg.learning_rate * gradient, -cfg.parameter_clip, cfg.parameter_clip)


def ridge(beta: np.ndarray, weight: float) -> np.ndarray:
    out = weight * beta
    out[0] = 0.0
    return out


def drop_failed(betas: dict[int, np.ndarray], exp: int, *sums) -> bool:
    """Whether a model's sums are not finite. Such a model ends here and loses its coefficients; the others go on."""
    if all(np.isfinite(np.asarray(s, dtype=float)).all() for s in sums):
        return False
    betas.pop(exp, None)
    logger.warning("model %s ends without coefficients: its sums are not finite", exp)
    return True


def with_model(df: DataFrame) -> DataFrame:
    """Single-model tables get model number 0."""
    return df if "exp" in df.columns else df.withColumn("exp", F.lit(0))


# --------------------------------------------------------------------------- partial sums in numpy


def gaps_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN becomes NULL. A missing cell is skipped by every sum that needs it, whichever way the sum is taken: the
    products with it in the linear moments, the whole row in logistic and softmax gradients. Row counts keep the row."""
    kinds = dict(df.dtypes)
    floating = [c for c in columns if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None).cast(kinds[c])) for c in floating})


def whole_rows(block: np.ndarray) -> np.ndarray:
    return block[~np.isnan(block).any(axis=1)]


def numpy_partials(df: DataFrame, groups: Sequence[str], inputs: Sequence[str], kernel) -> DataFrame:
    """Sum of ``kernel(group, matrix)`` vectors per group: (groups, cell, value).

    A task keeps one vector per group it meets, and Spark adds the vectors of all tasks.
    """
    groups, inputs = list(groups), list(inputs)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby(groups, sort=False):
                name = name if isinstance(name, tuple) else (name,)
                # what is not finite stays so in the sums, and fails its own group
                with np.errstate(all="ignore"):
                    vector = kernel(name, part[inputs].to_numpy(dtype=float))
                sums[name] = sums[name] + vector if name in sums else vector
        if sums:
            frame = pd.DataFrame(list(sums), columns=groups)
            frame["v"] = [v.tolist() for v in sums.values()]
            yield frame

    types = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)
    partial = df.select(*groups, *[quoted(c) for c in inputs]).mapInPandas(run, f"{types}, v array<double>")
    cells = partial.select(*groups, F.posexplode("v").alias("cell", "value"))
    return cells.groupBy(*groups, "cell").agg(F.sum("value").alias("value"))


# --------------------------------------------------------------------------- linear


def _upper(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d + 1) for b in range(a, d + 1)]


def moments(df: DataFrame, features: Sequence[str], label: str, groups: Sequence[str] = ("exp",)) -> DataFrame:
    """One row per group: ``m`` = upper triangle of X'X (with bias), then X'y, as one array."""
    features, groups = list(features), list(groups)
    df = gaps_as_null(df, [*features, label])
    d = len(features)
    pairs = _upper(d)
    if len(pairs) + d + 1 <= MAX_AGGREGATES:
        x: list[Column] = [F.lit(1.0)] + [quoted(c) for c in features]
        y = quoted(label)
        cells = [F.count(F.lit(1)).cast("double")] + [F.sum(x[a] * x[b]) for a, b in pairs[1:]]
        cells += [F.sum(y)] + [F.sum(xk * y) for xk in x[1:]]
        # a sum over nothing but missing cells is 0, as in the other path
        cells = [F.coalesce(c, F.lit(0.0)) for c in cells]
        return df.groupBy(*groups).agg(*[c.alias(f"__{n}") for n, c in enumerate(cells)]).select(
            *groups, F.array(*[f"__{n}" for n in range(len(cells))]).alias("m")
        )

    upper = np.triu_indices(d + 1)

    def kernel(_, block):
        block = np.where(np.isnan(block), 0.0, block)
        xb = np.concatenate([np.ones((len(block), 1)), block[:, :-1]], axis=1)
        return np.concatenate([(xb.T @ xb)[upper], xb.T @ block[:, -1]])

    cells = numpy_partials(df, groups, [*features, label], kernel)
    listed = F.array_sort(F.collect_list(F.struct("cell", "value")))
    return cells.groupBy(*groups).agg(F.transform(listed, lambda s: s["value"]).alias("m"))


def _unpack(m: Sequence[float], d: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = _upper(d)
    gram = np.zeros((d + 1, d + 1))
    for (a, b), v in zip(pairs, m):
        gram[a, b] = gram[b, a] = v
    return gram, np.asarray(m[len(pairs) :], dtype=float)


def linear_step(beta: np.ndarray, gram: np.ndarray, moment: np.ndarray, rows: float, cfg: TrainConfig) -> np.ndarray:
    gradient = 2.0 * (gram @ beta - moment) / rows + ridge(beta, 2.0 * cfg.regularization)
    return descend(beta, gradient, cfg)


def starts(
    df: DataFrame, label: str, model: str, d: int, missing_is_zero: bool = False
) -> tuple[dict[int, np.ndarray], int]:
    """Coefficients before the first step of linear and logistic models, and the rows of the largest model.

    ``missing_is_zero`` averages over all rows, as the moments of a full batch do.
    """
    y = quoted(label)
    mean = F.avg(F.coalesce(y, F.lit(0)) if missing_is_zero else y)
    means = gaps_as_null(df, [label]).groupBy("exp").agg(mean.alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    betas: dict[int, np.ndarray] = {}
    for row in means:
        if row["mean"] is None or drop_failed(betas, row["exp"], row["mean"]):
            continue
        p = min(max(row["mean"], PRIOR_FLOOR), 1 - PRIOR_FLOOR)
        betas[row["exp"]] = np.zeros(d + 1)
        betas[row["exp"]][0] = math.log(p / (1 - p)) if model == "logistic" else row["mean"]
    return betas, max((r["n"] for r in means), default=0)


def train_linear(df: DataFrame, features: Sequence[str], label: str, cfg: TrainConfig, key: Column | None = None):
    """Coefficients per model: ``{exp: array(d + 1)}``."""
    df = with_model(df)
    d = len(features)
    betas: dict[int, np.ndarray] = {}
    if cfg.batch_size <= 0:
        for row in moments(df, features, label).collect():
            gram, moment = _unpack(row["m"], d)
            if drop_failed(betas, row["exp"], gram, moment):
                continue
            beta = np.zeros(d + 1)
            beta[0] = moment[0] / gram[0, 0]
            for _ in range(cfg.epochs):
                beta = linear_step(beta, gram, moment, gram[0, 0], cfg)
            betas[row["exp"]] = beta
        return betas

    betas, rows = starts(df, label, "linear", d)
    if cfg.epochs <= 0:
        return betas
    _check_steps(rows // cfg.batch_size * cfg.epochs, cfg)
    if key is None:
        raise ValueError("mini-batches need the row key")
    batched = _batches(_keyed(df, [*features, label], key), F.col("__key"), cfg, rows)
    per_batch = moments(batched, features, label, ("exp", "epoch", "batch_id")).where(F.col("exp").isin(list(betas)))
    return replay(per_batch, betas, d, cfg)


def replay(per_batch: DataFrame, betas: dict[int, np.ndarray], d: int, cfg: TrainConfig) -> dict[int, np.ndarray]:
    """The steps of every model in order, from the moments of its batches.

    The steps depend on each other, so a model's moments stream through one task, an Arrow batch at a time; that task
    keeps the coefficients alone, and models run beside each other. Only coefficients reach the driver.
    """

    def run(frames):
        state = {exp: beta.copy() for exp, beta in betas.items()}
        met = set()
        for pdf in frames:
            for exp, m in zip(pdf["exp"], pdf["m"]):
                met.add(exp)
                gram, moment = _unpack(m, d)
                if exp in state and not drop_failed(state, exp, gram, moment):
                    state[exp] = linear_step(state[exp], gram, moment, float(cfg.batch_size), cfg)
        yield pd.DataFrame({"exp": list(met), "beta": [state[e].tolist() if e in state else None for e in met]})

    ordered = per_batch.repartition("exp").sortWithinPartitions("exp", "epoch", "batch_id").select("exp", "m")
    out = dict(betas)
    for row in ordered.mapInPandas(run, f"exp {per_batch.schema['exp'].dataType.simpleString()}, beta array<double>").collect():
        if row["beta"] is None:
            drop_failed(out, row["exp"], math.nan)
        else:
            out[row["exp"]] = np.array(row["beta"])
    return out


def _check_steps(steps: int, cfg: TrainConfig) -> None:
    if cfg.max_steps is not None and steps > cfg.max_steps:
        raise ValueError(
            f"{steps} sequential steps exceed max_steps={cfg.max_steps}: gradient steps depend on each other and "
            "cannot run in parallel; use a larger batch_size, full batch (batch_size <= 0), or raise max_steps"
        )


def _keyed(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    """What batches need of a row, and no more."""
    return df.select(*[c for c in ("exp", "seed") if c in df.columns], key.alias("__key"), *[quoted(c) for c in columns])


def _batches(df: DataFrame, key: Column, cfg: TrainConfig, rows: int) -> DataFrame:
    """Rows of all epochs with ``epoch`` and ``batch_id``."""
    if cfg.order == "permuted":
        parts = [part.withColumn("epoch", F.lit(n)) for n, part in enumerate(_epochs(df, key, cfg, rows))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    return assign_batches(df, key, cfg.batch_size, cfg.epochs, _seed(df, cfg), rows=rows, partition=["exp"])


def _seed(df: DataFrame, cfg: TrainConfig):
    return F.col("seed") if "seed" in df.columns else cfg.seed


def _epochs(df: DataFrame, key: Column, cfg: TrainConfig, rows: int):
    """The rows of one epoch after the other with their ``batch_id``, so that no more than one copy is kept at a time."""
    if cfg.order == "hash":
        for epoch in range(cfg.epochs):
            yield assign_batches(df, key, cfg.batch_size, [epoch], _seed(df, cfg), rows=rows, partition=["exp"])
        return
    if "seed" in df.columns:
        seeds = {r["exp"]: r["seed"] for r in df.groupBy("exp").agg(F.min("seed").alias("seed")).collect()}
    else:
        seeds = {r["exp"]: cfg.seed for r in df.select("exp").distinct().collect()}
    ranked = settle(hash_ranks(df, key, rows=rows, partition=["exp"]))
    for epoch in range(cfg.epochs):
        keys = [constants(seeds.get(exp, cfg.seed), epoch) for exp in range(max(seeds, default=0) + 1)]
        yield in_batches(ranked, cfg.batch_size, keys, F.col("exp").cast("int")).drop("__rank", "__all")


# --------------------------------------------------------------------------- logistic


def logistic_gradients(
    df: DataFrame, features: Sequence[str], label: str, betas: dict[int, np.ndarray]
) -> dict[int, tuple[float, np.ndarray]]:
    """Rows and X'(p - y) per model, one job."""
    df = gaps_as_null(df, [*features, label])
    d = len(features)
    if d + 2 <= MAX_AGGREGATES:
        ready, b = with_coefficients(df, betas, d + 1)
        z = dot([quoted(c) for c in features], [b(k + 1) for k in range(d)], b(0))
        scored = ready.withColumn("__e", sigmoid(z) - quoted(label))
        sums = [F.sum("__e").alias("g0")] + [F.sum(F.col("__e") * quoted(c)).alias(f"g{k + 1}") for k, c in enumerate(features)]
        rows = scored.groupBy("exp").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
        return {r["exp"]: (float(r["n"]), np.array([r[f"g{k}"] or 0.0 for k in range(d + 1)])) for r in rows}

    def kernel(name, block):
        n, block = len(block), whole_rows(block)
        xb = np.concatenate([np.ones((len(block), 1)), block[:, :-1]], axis=1)
        z = np.clip(xb @ betas[name[0]], -Z_LIMIT, Z_LIMIT)
        return np.concatenate([[n], xb.T @ (1.0 / (1.0 + np.exp(-z)) - block[:, -1])])

    return _collect_vectors(numpy_partials(df, ["exp"], [*features, label], kernel), d + 2)


def with_coefficients(df: DataFrame, betas: dict[int, np.ndarray], width: int):
    """The table with its model's coefficients in the array column ``__b``, and the accessor of element k."""
    models = sorted(betas)
    dense = np.zeros((models[-1] + 1, width))
    for m in models:
        dense[m] = np.asarray(betas[m]).ravel()
    return Table(dense, F.col("exp").cast("int")).attach(df, "__b")


def _collect_vectors(cells: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray]]:
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r["exp"], np.zeros(width))[r["cell"]] = r["value"]
    return {exp: (v[0], v[1:]) for exp, v in out.items()}


def train_logistic(df: DataFrame, features: Sequence[str], label: str, cfg: TrainConfig, key: Column | None = None):
    df = with_model(df)
    d = len(features)
    betas, most = starts(df, label, "logistic", d)

    def step(part: DataFrame):
        if not betas:
            return
        part = part.where(F.col("exp").isin(list(betas)))
        for exp, (n, total) in logistic_gradients(part, features, label, betas).items():
            if drop_failed(betas, exp, total):
                continue
            betas[exp] = descend(betas[exp], total / n + ridge(betas[exp], cfg.regularization), cfg)

    _iterate(df, [*features, label], key, cfg, most, step)
    return betas


def _iterate(df: DataFrame, columns, key, cfg: TrainConfig, rows: int, step) -> None:
    """Run the steps over cached rows: whole table per epoch, or one mini-batch after the other."""
    if cfg.epochs <= 0:
        return
    if cfg.batch_size <= 0:
        source = df.select("exp", *[quoted(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for _ in range(cfg.epochs):
                step(source)
        finally:
            source.unpersist()
        return
    per_epoch = rows // cfg.batch_size
    _check_steps(per_epoch * cfg.epochs, cfg)
    if per_epoch == 0:
        return
    if key is None:
        raise ValueError("mini-batches need the row key")
    # clustered by batch: the cache keeps min/max per block, so a step reads only its own batch; the hash in the
    # order lets a large batch span many partitions
    place = ["batch_id", "__place"]
    for epoch in _epochs(_keyed(df, columns, key), F.col("__key"), cfg, rows):
        batched = (
            epoch.select("exp", "batch_id", *[quoted(c) for c in columns], F.xxhash64("__key").alias("__place"))
            .repartitionByRange(*place)
            .sortWithinPartitions(*place)
            .drop("__place")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        try:
            for batch in range(per_epoch):
                step(batched.where(F.col("batch_id") == batch))
        finally:
            batched.unpersist()


# --------------------------------------------------------------------------- softmax


def softmax_columns(features: Sequence[Column], b, k: int) -> list[Column]:
    """Clipped class scores; parameter (row r, class c) sits at r * k + c."""
    return [
        clip(dot(features, [b((r + 1) * k + c) for r in range(len(features))], b(c)), -Z_LIMIT, Z_LIMIT)
        for c in range(k)
    ]


def add_softmax(df: DataFrame, features: Sequence[str], betas: dict[int, np.ndarray], k: int) -> DataFrame:
    """Add class probabilities ``__p0`` .. and their maximum ``__pmax``, layer by layer."""
    ready, b = with_coefficients(df, betas, (len(features) + 1) * k)
    scores = softmax_columns([quoted(c) for c in features], b, k)
    z = ready.select("*", *[s.alias(f"__z{c}") for c, s in enumerate(scores)]).drop("__b")
    top = F.greatest(*[F.col(f"__z{c}") for c in range(k)]) if k > 1 else F.col("__z0")
    e = z.withColumn("__top", top).select("*", *[F.exp(F.col(f"__z{c}") - F.col("__top")).alias(f"__x{c}") for c in range(k)])
    total = F.col("__x0")
    for c in range(1, k):
        total = total + F.col(f"__x{c}")
    p = e.withColumn("__sum", total).select("*", *[(F.col(f"__x{c}") / F.col("__sum")).alias(f"__p{c}") for c in range(k)])
    best = F.greatest(*[F.col(f"__p{c}") for c in range(k)]) if k > 1 else F.col("__p0")
    dropped = [f"__{n}{c}" for n in "zx" for c in range(k)] + ["__top", "__sum"]
    return p.withColumn("__pmax", best).drop(*dropped)


def softmax_gradients(df: DataFrame, features: Sequence[str], label: str, betas: dict[int, np.ndarray], k: int):
    """Rows and X'(P - Y) per model, one job. ``label`` holds class codes 0..k-1."""
    df = gaps_as_null(df, [*features, label])
    d = len(features)
    width = (d + 1) * k
    if width + 1 <= min(MAX_AGGREGATES, MAX_SOFTMAX_AGGREGATES):
        scored = add_softmax(df, features, betas, k)
        error = scored.select(
            "exp",
            *[quoted(c) for c in features],
            *[
                (F.col(f"__p{c}") - (quoted(label) == c).cast("double")).alias(f"__e{c}")
                for c in range(k)
            ],
        )
        sums = [F.sum(f"__e{c}") for c in range(k)]
        sums += [F.sum(quoted(x) * F.col(f"__e{c}")) for x in features for c in range(k)]
        rows = (
            error.groupBy("exp")
            .agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"g{i}") for i, s in enumerate(sums)])
            .collect()
        )
        return {r["exp"]: (float(r["n"]), np.array([r[f"g{i}"] or 0.0 for i in range(width)])) for r in rows}

    def kernel(name, block):
        n, block = len(block), whole_rows(block)
        xb = np.concatenate([np.ones((len(block), 1)), block[:, :-1]], axis=1)
        z = np.clip(xb @ betas[name[0]].reshape(d + 1, k), -Z_LIMIT, Z_LIMIT)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        hot = block[:, -1][:, None] == np.arange(k)[None, :]
        return np.concatenate([[n], (xb.T @ (p - hot)).ravel()])

    return _collect_vectors(numpy_partials(df, ["exp"], [*features, label], kernel), width + 1)


# A class that a model never saw keeps this bias: its score is clipped to the lowest value, which adds nothing
# to a sum of probabilities in double precision.
ABSENT_BIAS = -1e9


def train_softmax(df: DataFrame, features: Sequence[str], label: str, cfg: TrainConfig, key: Column | None = None):
    """``{exp: array(d + 1, K)}``. Class codes are 0-based; K is the largest number of classes of any model."""
    df = with_model(df)
    d = len(features)
    known = gaps_as_null(df, [label]).where(quoted(label).isNotNull())
    counts = known.groupBy("exp", quoted(label).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    k = max(r["c"] for r in counts) + 1
    totals: dict[int, int] = {}
    for r in counts:
        totals[r["exp"]] = totals.get(r["exp"], 0) + r["n"]
    betas = {exp: np.zeros((d + 1, k)) for exp in totals}
    present = {exp: np.zeros(k, dtype=bool) for exp in totals}
    for r in counts:
        share = min(max(r["n"] / totals[r["exp"]], PRIOR_FLOOR), 1 - PRIOR_FLOOR)
        betas[r["exp"]][0, r["c"]] = math.log(share)
        present[r["exp"]][r["c"]] = True
    for exp, has in present.items():
        betas[exp][0, ~has] = ABSENT_BIAS

    def step(part: DataFrame):
        if not betas:
            return
        part = part.where(F.col("exp").isin(list(betas)))
        for exp, (n, total) in softmax_gradients(part, features, label, betas, k).items():
            if drop_failed(betas, exp, total):
                continue
            has = present[exp]
            beta = betas[exp]
            gradient = total.reshape(d + 1, k) / n + ridge(beta, cfg.regularization)
            moved = descend(beta[:, has], gradient[:, has], cfg)
            beta = beta.copy()
            beta[:, has] = moved
            betas[exp] = beta

    _iterate(df, [*features, label], key, cfg, max(totals.values()), step)
    return betas


def train(df: DataFrame, features: Sequence[str], label: str, cfg: TrainConfig, key: Column | None = None):
    """Coefficients of every model that could be trained. A model whose labels are all missing, or whose sums are not
    finite at some step, has none, whichever way the sums are taken; it does not disturb the others."""
    fitter = {"linear": train_linear, "logistic": train_logistic, "softmax": train_softmax}[cfg.model]
    return fitter(df, features, label, cfg, key)


def coefficient_table(spark, betas: dict[int, np.ndarray], features: Sequence[str]) -> DataFrame:
    """Long form (exp, class, feature, beta); linear and logistic models have class 0."""
    names = ["(bias)", *features]
    rows = [
        (int(exp), c, name, float(np.atleast_2d(b.T).T[r, c]))
        for exp, b in sorted(betas.items())
        for c in range(np.atleast_2d(b.T).T.shape[1])
        for r, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "exp int, class int, feature string, beta double")
