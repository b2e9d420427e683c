"""Train and compare: one model on raw data and one per privatised run, trained and scored together.

All variants become one long table with a model number; statistics, training steps and metrics are grouped
aggregates over it. Only scalars per model reach the driver.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import Table
from ..operators import evaluate as ev
from ..operators import score as sc
from ..operators.profile import numeric_columns, quoted
from ..operators.scale import model_range
from ..operators.split import is_test
from ..operators.train import ABSENT_BIAS, TrainConfig, train
from ..session import scratch_path
from ..sources import runstore
from .config import Dataset, Run
from .privatise import Fitted, dataset_key, label_metadata, model_features, prepare_and_fit, privatise

logger = logging.getLogger(__name__)

METRICS = {
    "linear": {"rmse": "RMSE", "mae": "MAE"},
    "logistic": {"accuracy": "Accuracy", "auc": "AUC"},
    "softmax": {"accuracy": "Accuracy", "auc_macro": "AUC_macro"},
}


# how many runs an error message names
MAX_NAMED = 3


@dataclass(frozen=True)
class CompareConfig:
    train: TrainConfig = field(default_factory=TrainConfig)
    n_outputs: int = 7
    # log the linearly mapped label a second time before training, as some published runs did
    double_log: bool = False
    response_mode: str = "strict"
    null_policy: str = "null"

    @property
    def model(self) -> str:
        return self.train.model


@dataclass(frozen=True)
class Experiment:
    """One model: ``run`` is None for the raw data."""

    exp: int
    seed: int
    run: Run | None

    @property
    def variant(self) -> str:
        return "raw" if self.run is None else self.run.variant


def plan_experiments(runs: Sequence[Run], cfg: CompareConfig) -> list[Experiment]:
    """Raw models first. Without mini-batches the seed has no effect on raw data: one model serves all."""
    seeds = sorted({r.seed for r in runs}) if cfg.train.batch_size > 0 else [cfg.train.seed]
    raw = [Experiment(n, s, None) for n, s in enumerate(seeds)]
    return raw + [Experiment(len(raw) + n, r.seed, r) for n, r in enumerate(runs)]


def check_same_ids(raw: DataFrame, privatised: DataFrame, keys: Sequence[str]) -> None:
    """Every given run must hold every raw id once, and no other id. A run that is not there at all is no error here.

    Both tables are counted per id before one shuffle; nothing is joined. Runs of a store are checked by the sums of its
    manifest instead, without a look at their rows.
    """
    columns = [quoted(c) for c in keys]
    sides = raw.select(*columns, F.lit(1).alias("__raw"), F.lit(None).cast("string").alias("__run")).unionByName(
        privatised.select(*columns, F.lit(0).alias("__raw"), F.col("run_id").alias("__run"))
    )
    counts = sides.groupBy(*columns).agg(F.sum("__raw").alias("__raw"), F.count("__run").alias("__rows"))
    runs = F.lit(privatised.select("run_id").distinct().count())
    if not counts.where((F.col("__raw") != 1) | (F.col("__rows") != runs)).isEmpty():
        raise KeyError(f"raw and privatised rows do not have the same {', '.join(keys)} in every run")


def by_run_key(privatised: DataFrame, dataset: Dataset, runs: Sequence[Run]) -> DataFrame:
    """``run``, the number in ``runs``, from the full run key of the rows. Rows of a run that is not listed are an error."""
    ids = [runstore.run_id(dataset.name, r) for r in runs]
    tagged = privatised if "run_id" in privatised.columns else privatised.withColumn("run_id", runstore.run_id_column())
    strangers = tagged.select("run_id").distinct().where(~F.col("run_id").isin(ids))
    if not strangers.isEmpty():
        one = tagged.join(strangers, "run_id", "left_semi").select(*runstore.RUN_COLUMNS).first()
        raise KeyError(f"stored rows of a run that is not among the runs to compare: {one.asDict()}")
    return numbered(tagged, ids)


def numbered(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    # one row for each run of the grid
    numbers = rows.sparkSession.createDataFrame(list(zip(ids, range(len(ids)))), "__id string, run int")
    return rows.drop("run").join(F.broadcast(numbers), F.col("run_id") == F.col("__id")).drop("__id")


def from_store(prepared: DataFrame, dataset: Dataset, runs: Sequence[Run], root: str) -> DataFrame:
    """The rows of the listed runs from a store, checked against the raw ids. Other runs of the store are not opened."""
    spark = prepared.sparkSession
    ids = [runstore.run_id(dataset.name, r) for r in runs]
    listed = runstore.manifest(spark, root, dataset=dataset.name).where(F.col("run_id").isin(ids)).collect()
    if not listed:
        raise KeyError(f"none of the runs is stored under {root}")
    wrong = runstore.differing_keys(prepared, listed, dataset.key)
    if wrong:
        names = [{c: r[c] for c in runstore.RUN_COLUMNS} for r in wrong[:MAX_NAMED]]
        raise KeyError(f"{len(wrong)} stored runs do not hold the raw {', '.join(dataset.key)}: {names}")
    return numbered(runstore.read_runs(spark, root, listed), ids)


def stack(
    raw: DataFrame, privatised: DataFrame, dataset: Dataset, features: Sequence[str], experiments: Sequence[Experiment]
) -> DataFrame:
    """(exp, seed, is_test, key, features, label) for all models. Privatised rows carry ``run``."""
    numeric = dataset.label in numeric_columns(raw)
    label = quoted(dataset.label).cast("double" if numeric else "string")
    raws = [e for e in experiments if e.run is None]
    shift = len(raws)
    keys = [quoted(c) for c in dataset.key]
    xs = [quoted(c).cast("double").alias(c) for c in features]
    seeds = Table([[e.seed] for e in raws], F.col("exp"))
    first = (
        raw.withColumn("is_test", is_test(dataset_key(dataset), dataset.test_size, dataset.random_state, dataset.salt))
        .withColumn("exp", F.explode(F.sequence(F.lit(0), F.lit(shift - 1))))
        .select("exp", seeds.at(0).cast("int").alias("seed"), "is_test", *keys, *xs, label.alias("label"))
    )
    rest = privatised.select(
        (F.col("run") + shift).cast("int").alias("exp"),
        F.col("seed").cast("int").alias("seed"),
        (F.col("split") == "test").alias("is_test"),
        *keys,
        *xs,
        label.alias("label"),
    )
    return first.unionByName(rest)


def fitted_columns(
    stacked: DataFrame, features: Sequence[str], experiments: Sequence[Experiment], numeric_label: bool, n_outputs: int
):
    """Train statistics of every model in one job, then imputation and scaling as table look-ups.

    Returns the imputed, scaled table and the raw models' label mean. A model with an infinite train cell cannot be
    scaled; its rows are left out, and with them its scores.
    """
    wanted = []
    for c in features:
        x = F.when(~F.col("is_test"), quoted(c))
        wanted += [F.avg(x).alias(f"mean|{c}"), F.min(x).alias(f"min|{c}"), F.max(x).alias(f"max|{c}")]
    if numeric_label:
        wanted.append(F.avg(F.when(~F.col("is_test"), F.col("label"))).alias("mean|label"))
    rows = {r["exp"]: r for r in stacked.groupBy("exp").agg(*wanted).collect()} if wanted else {}
    broken = [exp for exp, r in rows.items() if any(v is not None and math.isinf(v) for c, v in r.asDict().items() if c != "exp")]
    if broken:
        logger.warning("models %s hold infinite train cells and are left without scores", broken)
        stacked = stacked.where(~F.col("exp").isin(broken))
        rows = {exp: r for exp, r in rows.items() if exp not in broken}
    absent = dict.fromkeys([f"{s}|{c}" for c in (*features, "label") for s in ("mean", "min", "max")])
    lo, hi = model_range(n_outputs)
    block = []
    label_mean = None
    for e in experiments:
        # a run without rows is left without a score; the others go on
        r = rows.get(e.exp, absent)
        scaled = e.run is None or e.run.mechanism == "pm"
        line = [lo if scaled else 0.0, hi - lo if scaled else 1.0]
        for c in features:
            mean, low, high = r[f"mean|{c}"], r[f"min|{c}"], r[f"max|{c}"]
            spread = 1.0 if low is None or high == low else high - low
            line += [
                float("nan") if mean is None else mean,
                (0.0 if low is None else low) if scaled else 0.0,
                spread if scaled else 1.0,
            ]
        mean = r["mean|label"] if numeric_label else None
        line.append(float("nan") if mean is None else mean)
        if e.run is None and label_mean is None:
            label_mean = mean
        block.append(line)
    stacked, constant = Table(block, F.col("exp")).attach(stacked, "__t")
    exprs = {}
    for n, c in enumerate(features):
        base = 2 + 3 * n
        filled = F.coalesce(quoted(c), F.nanvl(constant(base), F.lit(None).cast("double")))
        value = constant(0) + (filled - constant(base + 1)) / constant(base + 2) * constant(1)
        exprs[c] = F.coalesce(value, F.lit(0.0))
    if numeric_label:
        exprs["y"] = F.coalesce(F.col("label"), F.nanvl(constant(2 + 3 * len(features)), F.lit(None).cast("double")))
    else:
        exprs["y"] = F.col("label")
    return stacked.withColumns(exprs).drop("__t"), label_mean


def encode_classes(stacked: DataFrame, experiments: Sequence[Experiment]) -> DataFrame:
    """Per model: class code of the train labels (sorted distinct), and the raw code as truth, -1 if unseen.

    Codes are ranks among a model's distinct labels, of which there are as many as the model has classes. Spark chooses
    the join by the size of the code table.
    """
    seen = stacked.where(~F.col("is_test") & F.col("y").isNotNull()).select("exp", "y").distinct()
    code = F.row_number().over(Window.partitionBy("exp").orderBy("y")) - 1
    codes = seen.select(F.col("exp").alias("__e"), F.col("y").alias("__y"), code.alias("code"))
    raw = next(e.exp for e in experiments if e.run is None)
    truths = codes.where(F.col("__e") == raw).select(F.col("__y").alias("__ty"), F.col("code").alias("__truth"))
    coded = stacked.join(codes, (F.col("exp") == F.col("__e")) & (F.col("y") == F.col("__y")), "left").drop("__e", "__y")
    coded = coded.join(truths, F.col("y") == F.col("__ty"), "left").drop("__ty")
    return coded.withColumns(
        {
            "code": F.coalesce(F.col("code"), F.lit(-1)),
            "truth": F.when(F.col("is_test"), F.coalesce(F.col("__truth"), F.lit(-1))),
        }
    ).drop("__truth")


def compare(
    raw: DataFrame,
    dataset: Dataset,
    runs: Sequence[Run],
    cfg: CompareConfig,
    *,
    store: str | None = None,
    privatised: DataFrame | None = None,
    catalog_path: str | None = None,
) -> DataFrame:
    """Long scores (dataset, eps, label_eps, seed, variant, mode, metric, value), rounded to 3 decimals.

    ``store`` names a run store, ``privatised`` gives rows with their run columns; otherwise they are made here. Stored rows
    belong to a run by its full key, in whatever order. A run without rows or without a defined metric keeps its row with
    NULL, and the other runs keep their scores.
    """
    (scores,) = _scores(raw, dataset, runs, [cfg], store, privatised, catalog_path)
    return scores


def _scores(raw, dataset: Dataset, runs: Sequence[Run], points: Sequence[CompareConfig], store, privatised, catalog_path):
    """One table of scores per configuration. They differ in training only, so the rows are profiled, privatised,
    stacked once, for all of them."""
    cfg = next((p for p in points if p.train.batch_size > 0), points[0])
    prepared, fitted = prepare_and_fit(raw, dataset, any(r.mode == "categorical" for r in runs))
    numeric_label = dataset.label in numeric_columns(prepared)
    features = model_features(prepared, fitted)
    experiments = plan_experiments(runs, cfg)
    if store is not None:
        privatised = from_store(prepared, dataset, runs, store)
    elif privatised is not None:
        privatised = by_run_key(privatised, dataset, runs)
        check_same_ids(prepared, privatised, dataset.key)
    else:
        privatised = privatise(
            prepared, fitted, runs, catalog_path=catalog_path, response_mode=cfg.response_mode, null_policy=cfg.null_policy
        )

    stacked = stack(prepared, privatised, dataset, features, experiments)
    # written once: wide projections are planned and run a single time, and the rows outlive an executor
    path = scratch_path(raw.sparkSession, "stacked")
    stacked.write.parquet(path)
    stacked = raw.sparkSession.read.parquet(path)
    ready, label_mean = fitted_columns(stacked, features, experiments, numeric_label, cfg.n_outputs)
    key = F.concat_ws("-", *[quoted(c).cast("string") for c in dataset.key])
    for point in points:
        if point.model == "softmax":
            scores = _softmax(ready, features, experiments, point, key)
        else:
            scores = _numeric(ready, features, experiments, point, key, fitted, label_mean)
        # a handful of rows per model; none if no model could be trained
        rows = [] if scores is None else [(r["exp"], r["metric"], r["value"]) for r in scores.collect()]
        yield _named(raw.sparkSession, rows, dataset, experiments, METRICS[point.model].values())


def _of_models(rows: DataFrame, betas: dict) -> DataFrame:
    """Rows of the models that could be trained."""
    return rows.where(F.col("exp").isin([int(e) for e in betas]))


def _numeric(ready, features, experiments, cfg: CompareConfig, key: Column, fitted: Fitted, label_mean) -> DataFrame | None:
    log = fitted.dataset.log_label and cfg.model == "linear"
    y = F.col("y")
    if cfg.double_log and log:
        again = Table([[1.0 if e.run is not None and e.run.mode == "linear" else 0.0] for e in experiments], F.col("exp"))
        y = F.when(again.at(0) == 1.0, F.log1p(y)).otherwise(y)
    rows = ready.where(~F.col("is_test")).withColumn("y", y)
    betas = train(rows, features, "y", cfg.train, key)
    if not betas:
        return None
    test = _of_models(ready.where(F.col("is_test")), betas).withColumn(
        "truth", F.coalesce(F.col("label"), F.lit(label_mean).cast("double"))
    )
    if cfg.model == "logistic":
        scored = sc.predict_logistic(test, features, betas)
        return ev.stack_metrics(ev.binary_report(scored, "truth", "prob", ["exp"]), ["exp"], METRICS["logistic"])
    scored = sc.predict_linear(test, features, betas)
    metadata = {(m["mechanism"], m["eps"], m["t"], m["n_outputs"], m["obj"], m["label_eps"], m["label_n"], m["seed"]): m
                for m in label_metadata(fitted, [e.run for e in experiments if e.run is not None])}
    bounds = []
    for e in experiments:
        r = e.run
        m = metadata.get((r.mechanism, r.eps, r.t, r.n_outputs, r.obj, r.label_eps, r.label_n, r.seed)) if r and r.mode == "index" else None
        bounds.append([m["index_min"], m["index_max"], m["label_min"], m["label_max"]] if m else [float("nan")] * 4)
    table = Table(bounds, F.col("exp"))
    null = F.lit(None).cast("double")
    pred = sc.invert_label(F.col("pred"), *[F.nanvl(table.at(k), null) for k in range(4)])
    truth = F.col("truth")
    if log:
        pred, truth = F.expm1(pred), F.expm1(truth)
    final = scored.select("exp", truth.alias("truth"), pred.alias("pred"))
    return ev.stack_metrics(ev.rmse_mae(final, "truth", "pred", ["exp"]), ["exp"], METRICS["linear"])


def _softmax(ready, features, experiments, cfg: CompareConfig, key: Column) -> DataFrame | None:
    raws = [e.exp for e in experiments if e.run is None]
    coded = encode_classes(ready, experiments)
    betas = train(coded.where(~F.col("is_test")), features, "code", cfg.train, key)
    if not betas:
        return None
    k = next(iter(betas.values())).shape[1]
    scored = sc.predict_softmax(_of_models(coded.where(F.col("is_test")), betas), features, betas)
    # rows of an unseen class leave the raw variant only
    kept = scored.where(~((F.col("exp") <= raws[-1]) & (F.col("truth") == -1)))
    # a model is judged on the classes it has seen; codes of the others come last
    sizes = [[int((betas[e.exp][0] != ABSENT_BIAS).sum()) if e.exp in betas else 0] for e in experiments]
    long = ev.unpivot_classes(kept, "truth", k, keys=["exp"]).where(F.col("class") < Table(sizes, F.col("exp")).at(0))
    macro = ev.auc(long, "hit", "score", ["exp", "class"]).groupBy("exp").agg(F.avg("auc").alias("auc_macro"))
    report = ev.accuracy(kept, "truth", "pred", ["exp"]).join(macro, "exp", "left")
    return ev.stack_metrics(report, ["exp"], METRICS["softmax"])


def _named(spark, scores, dataset: Dataset, experiments: Sequence[Experiment], metrics: Iterable[str]) -> DataFrame:
    """Scores with their run names. A raw model is listed under every budget and seed it stands for.

    A model without a score (failed or undefined) keeps its row with NULL.
    """
    by_exp: dict[int, dict[str, float | None]] = {}
    for exp, metric, value in scores:
        by_exp.setdefault(exp, {})[metric] = value if value is not None and math.isfinite(value) else None
    metrics = list(metrics)
    raws = [e for e in experiments if e.run is None]
    raw_of = {e.seed: e for e in raws}
    names: dict[tuple, int] = {}
    for e in experiments:
        if e.run is None:
            continue
        r = e.run
        names[(r.eps, r.label_eps, r.seed, r.mode, ev.variant_name(e.variant))] = e.exp
        names.setdefault((r.eps, r.label_eps, r.seed, r.mode, "Full"), raw_of.get(r.seed, raws[0]).exp)
    rows = [
        (dataset.name, eps, label_eps, seed, mode, variant, m, by_exp.get(exp, {}).get(m))
        for (eps, label_eps, seed, mode, variant), exp in names.items()
        for m in metrics
    ]
    schema = "dataset string, eps double, label_eps double, seed int, mode string, variant string, metric string, value double"
    return ev.rounded(spark.createDataFrame(rows, schema))


def mean_report(scores: DataFrame, model: str) -> DataFrame:
    """Mean over seeds per budget, mode and variant, one column per metric."""
    keys = ["dataset", "eps", "label_eps", "mode", "variant"]
    means = ev.seed_means(scores, [*keys, "metric"])
    return ev.wide_report(means, list(METRICS[model].values()), keys)


def training_grid(
    raw: DataFrame,
    dataset: Dataset,
    runs: Sequence[Run],
    cfg: CompareConfig,
    *,
    batch_sizes: Sequence[int] = (-1,),
    learning_rates: Sequence[float] = (0.05,),
    epochs: Sequence[int] = (5,),
    store: str | None = None,
    privatised: DataFrame | None = None,
    catalog_path: str | None = None,
) -> DataFrame:
    """Scores over a grid of hyper-parameters.

    The data are privatised, profiled and scaled once; each point then trains all runs (budgets, resolutions, seeds)
    together on the stacked rows.
    """
    grid = list(product(batch_sizes, learning_rates, epochs))
    points = [replace(cfg, train=replace(cfg.train, batch_size=b, learning_rate=lr, epochs=n)) for b, lr, n in grid]
    tagged = [
        scores.withColumns({"batch_size": F.lit(b), "learning_rate": F.lit(lr), "epochs": F.lit(n)})
        for (b, lr, n), scores in zip(grid, _scores(raw, dataset, runs, points, store, privatised, catalog_path))
    ]
    return reduce(DataFrame.unionByName, tagged)
