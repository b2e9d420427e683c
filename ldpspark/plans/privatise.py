"""Privatise a dataset under a grid of runs: one fitting job, then one pass over the rows.

The rows are exploded over the runs and perturbed by expressions that look their constants up by run number,
so the whole grid costs one scan and no shuffle. Train rows are perturbed; test rows get the test-side form;
test labels stay raw.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import piecewise, quantised, response
from ..functions.layers import project
from ..functions.params import Table
from ..functions.quantised import Quantised
from ..functions.rand import row_key
from ..operators.encode import Categories, categories, decode, ordinal_encode
from ..operators.privatise import scaled
from ..operators.profile import (
    MODEL_THRESHOLD,
    TRANSFORM_THRESHOLD,
    above,
    categorical_columns,
    drop_sparse,
    log_label,
    missing_columns,
    missing_from,
    nan_to_null,
    numeric_columns,
    quoted,
    require_column,
)
from ..operators.scale import Stats, fit, fit_columns, fitted_from, linear_map
from ..operators.split import is_test
from ..sources import catalog
from .config import Dataset, Run

# what privatisation needs of a column
RANGE = ("min", "max")


@dataclass
class Fitted:
    """Everything the projection needs from the data."""

    dataset: Dataset
    features: list[str]
    stats: dict[str, Stats]
    label_categories: Categories | None
    feature_categories: dict[str, Categories]
    # share of missing cells by column, if it was counted
    missing: dict[str, float] | None = None


def dataset_key(dataset: Dataset) -> Column:
    return row_key(*dataset.key)


def _clean(df: DataFrame, dataset: Dataset) -> DataFrame:
    """Label present, NaN as NULL, log label; the listed features, or all columns, categorical ones only if wanted."""
    require_column(df, dataset.label)
    clean = nan_to_null(df)
    if dataset.log_label:
        clean = log_label(clean, dataset.label)
    if dataset.features is not None:
        wanted = dict.fromkeys([*dataset.key, *dataset.features, dataset.label])
    elif dataset.with_categorical:
        wanted = clean.columns
    else:
        kept = {*dataset.key, dataset.label, *numeric_columns(clean)}
        wanted = [c for c in clean.columns if c in kept]
    return clean.select(*[quoted(c) for c in wanted])


def _may_be_sparse(clean: DataFrame, dataset: Dataset) -> list[str]:
    """Columns that are tested for missing cells: neither row key nor label nor listed features."""
    keep = {*dataset.key, dataset.label}
    return [] if dataset.features is not None else [c for c in clean.columns if c not in keep]


def prepare(df: DataFrame, dataset: Dataset) -> DataFrame:
    """Ingest rules: label present, NaN as NULL, log label, sparse columns out, categorical columns out."""
    clean = _clean(df, dataset)
    tested = _may_be_sparse(clean, dataset)
    return drop_sparse(clean, columns=tested) if tested else clean


def _is_train(dataset: Dataset) -> Column:
    return ~is_test(dataset_key(dataset), dataset.test_size, dataset.random_state, dataset.salt)


def prepare_and_fit(df: DataFrame, dataset: Dataset, categorical_label: bool = False) -> tuple[DataFrame, Fitted]:
    """``prepare`` and ``fit_dataset`` with one scan of the table, by one aggregate.

    Train ranges are taken of every numeric column beside the shares of missing cells, also of those that turn out to be
    sparse. ``Fitted.missing`` keeps the shares, from which ``model_features`` tells the features of a model without
    another scan. Categories are still a job for each categorical column. An empty table has no shares and no ranges,
    and keeps its columns.
    """
    clean = _clean(df, dataset)
    numeric, tested = numeric_columns(clean, dataset.key), _may_be_sparse(clean, dataset)
    wanted = [*missing_columns(tested), *fit_columns(numeric, RANGE, _is_train(dataset))]
    row = clean.agg(*wanted).head() if wanted else None
    missing = missing_from(row, tested)
    prepared = clean.drop(*above(missing, TRANSFORM_THRESHOLD))
    stats = {c: s for c, s in fitted_from(row, numeric, RANGE).items() if c in prepared.columns}
    return prepared, _fitted(prepared, dataset, stats, categorical_label, missing)


def model_features(prepared: DataFrame, fitted: Fitted) -> list[str]:
    """``usable_features`` by the shares of missing cells that ``prepare_and_fit`` has counted."""
    dataset = fitted.dataset
    if dataset.features is not None:
        return list(dataset.features)
    sparse = above(fitted.missing, MODEL_THRESHOLD)
    return [c for c in numeric_columns(prepared, {*dataset.key, dataset.label}) if c not in sparse]


def fit_dataset(prepared: DataFrame, dataset: Dataset, categorical_label: bool = False) -> Fitted:
    """Train ranges of all features and the label, in one aggregate over the train rows."""
    columns = numeric_columns(prepared, dataset.key)
    stats = fit(prepared, columns, RANGE, where=_is_train(dataset)) if columns else {}
    return _fitted(prepared, dataset, stats, categorical_label)


def _fitted(prepared, dataset: Dataset, stats: dict[str, Stats], categorical_label: bool, missing=None) -> Fitted:
    skip = {*dataset.key, dataset.label}
    train = _is_train(dataset)
    label_categories = categories(prepared, dataset.label, train) if categorical_label else None
    others = categorical_columns(prepared, skip) if dataset.with_categorical else []
    feature_categories = {c: categories(prepared, c, train) for c in others}
    return Fitted(dataset, numeric_columns(prepared, skip), stats, label_categories, feature_categories, missing)


def privatise(
    prepared: DataFrame,
    fitted: Fitted,
    runs: Sequence[Run],
    *,
    catalog_path: str | None = None,
    response_mode: str = "strict",
    null_policy: str = "null",
) -> DataFrame:
    """All runs in one table: run columns, ``run`` (number in ``runs``), ``split``, key, features, label.

    Runs that share mechanism, label mode and resolution share a projection; usually that is one or two.
    """
    groups: dict[tuple, list[int]] = {}
    for n, run in enumerate(runs):
        groups.setdefault((run.mechanism, run.mode, run.n_outputs, run.label_n), []).append(n)
    keys = [k for r in runs if r.mechanism == "qm" for k in _mechanism_keys(r)]
    mechanisms = catalog.design_mechanisms(prepared.sparkSession, keys, catalog_path) if keys else {}
    parts = [
        _privatise_group(prepared, fitted, runs, members, mechanisms, response_mode, null_policy)
        for members in groups.values()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _mechanism_keys(run: Run) -> list[tuple[str, float, int]]:
    keys = [catalog.lookup_key(run.obj, run.eps, run.n_outputs)]
    if run.mode in ("index", "linear"):
        keys.append(catalog.lookup_key(run.obj, run.label_eps, run.label_n))
    return keys


def _pm_params(runs: Sequence[Run], members: Sequence[int], row: Column, label: bool) -> dict[str, Column]:
    mechanisms = [piecewise.Piecewise(runs[n].label_eps if label else runs[n].eps, runs[n].t) for n in members]
    table = Table([[m.big_t, m.k, m.a, m.p_core] for m in mechanisms], row)
    return {name: table.at(c) for c, name in enumerate(("pm_t", "pm_k", "pm_a", "pm_p"))}


def _qm_keys(runs, members, label: bool) -> list[tuple[str, float, int]]:
    """Mechanism key per run."""
    pick = [(r.obj, r.label_eps, r.label_n) if label else (r.obj, r.eps, r.n_outputs) for r in (runs[n] for n in members)]
    return [catalog.lookup_key(*key) for key in pick]


def _qm_lookup(keys: list, mechanisms: dict[tuple, Quantised], which: Column) -> quantised.Lookup:
    """Runs that differ by seed only share a mechanism; ``which`` numbers the distinct ones."""
    return quantised.Lookup([mechanisms[k] for k in dict.fromkeys(keys)], which)


def _number_of(keys: list, row: Column) -> Column:
    order = {k: n for n, k in enumerate(dict.fromkeys(keys))}
    return Table([[order[k]] for k in keys], row).at(0).cast("int")


def _privatise_group(prepared, fitted: Fitted, runs, members, mechanisms, response_mode, null_policy) -> DataFrame:
    ds = fitted.dataset
    first: Run = runs[members[0]]
    row = F.col("__row")
    seeds = Table([[runs[n].seed] for n in members], row)
    key = F.col("__key")
    numeric_label = first.mode in ("index", "linear")

    based = prepared.withColumn("__key", dataset_key(ds))
    based = based.withColumn("__test", is_test(key, ds.test_size, ds.random_state, ds.salt))
    if first.mode == "categorical" and fitted.label_categories is None:
        raise ValueError("runs with a categorical label need fit_dataset(prepared, dataset, categorical_label=True)")
    if first.mode == "categorical":
        based = ordinal_encode(based, ds.label, fitted.label_categories, "__code", unknown=None)
    # scale once per row, before the rows are multiplied
    on_domain = {c: scaled(c, fitted.stats[c]) for c in fitted.features}
    if numeric_label:
        on_domain["__label"] = scaled(ds.label, fitted.stats[ds.label])
    based = based.withColumns(on_domain) if on_domain else based
    wide = based.withColumn("__row", F.explode(F.sequence(F.lit(0), F.lit(len(members) - 1))))
    wide = wide.withColumn("__seed", seeds.at(0).cast("int"))
    if first.mechanism == "qm":
        feature_keys, label_keys = _qm_keys(runs, members, False), _qm_keys(runs, members, True)
        wide = wide.withColumns({"__fm": _number_of(feature_keys, row), "__lm": _number_of(label_keys, row)})
    options = {"salt": ds.salt}

    stacks = []
    if first.mechanism == "pm":
        params = _pm_params(runs, members, row, False)
        test = {"test": F.col("__test"), "null_policy": "zero_or_nan" if null_policy == "reference" else "null"}
        stacks += [piecewise.perturb(c, quoted(c), params, key, F.col("__seed"), c, **options, **test) for c in fitted.features]
    else:
        lookup = _qm_lookup(feature_keys, mechanisms, F.col("__fm"))
        test = {"test": F.col("__test"), "null_policy": "lowest" if null_policy == "reference" else "null"}
        stacks += [quantised.sample(c, quoted(c), lookup, key, F.col("__seed"), c, **options, **test) for c in fitted.features]
    if numeric_label:
        if first.mechanism == "pm":
            label_params = _pm_params(runs, members, row, True)
            stacks.append(piecewise.perturb("__noisy", F.col("__label"), label_params, key, F.col("__seed"), ds.label, **options))
        else:
            label_lookup = _qm_lookup(label_keys, mechanisms, F.col("__lm"))
            stacks.append(quantised.sample("__noisy", F.col("__label"), label_lookup, key, F.col("__seed"), ds.label, **options))
    elif first.mode == "categorical":
        size = fitted.label_categories.size
        keep = Table([[response.keep_probability(runs[n].label_eps, size)] for n in members], row)
        stacks.append(
            response.respond_index(
                "__noisy", F.col("__code"), size, keep.at(0), key, F.col("__seed"), ds.label, mode=response_mode, **options
            )
        )
    noisy = project(wide, stacks)

    raw = quoted(ds.label)
    if first.mode == "none":
        label = raw
    elif first.mode == "categorical":
        noisy = decode(noisy, "__noisy", fitted.label_categories, "__category")
        label = F.when(F.col("__test"), raw).otherwise(F.col("__category"))
    else:
        value = F.col("__noisy").cast("double")
        if first.mode == "linear":
            s = fitted.stats[ds.label]
            bounds = Table([label_bounds(runs[n], mechanisms) for n in members], row)
            value = linear_map(value, bounds.at(0), bounds.at(1), F.lit(s.min), F.lit(s.max))
        label = F.when(F.col("__test"), raw.cast("double")).otherwise(value)

    hot = [
        F.when(quoted(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}")
        for c, cats in fitted.feature_categories.items()
        for v in cats.listed()
    ]
    return noisy.select(
        *_run_columns(ds, runs, members, row),
        F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train")).alias("split"),
        *[quoted(c) for c in ds.key],
        *[quoted(c).cast("double").alias(c) for c in fitted.features],
        *hot,
        label.alias(ds.label),
    )


def _run_columns(ds: Dataset, runs: Sequence[Run], members: Sequence[int], row: Column) -> list[Column]:
    first = runs[members[0]]
    block = Table([[n, runs[n].eps, runs[n].t or 0.0, runs[n].label_eps, runs[n].seed] for n in members], row)
    objs = F.array(*[F.lit(runs[n].obj) for n in members])
    return [
        F.lit(ds.name).alias("dataset"),
        F.lit(first.mechanism).alias("mechanism"),
        F.lit(first.mode).alias("mode"),
        block.at(0).cast("int").alias("run"),
        block.at(1).alias("eps"),
        (block.at(2) if first.mechanism == "pm" else F.lit(None).cast("double")).alias("t"),
        F.lit(first.n_outputs).cast("int").alias("n_outputs"),
        objs[row].alias("obj"),
        block.at(3).alias("label_eps"),
        F.lit(first.label_n).cast("int").alias("label_n"),
        block.at(4).cast("int").alias("seed"),
    ]


def label_bounds(run: Run, mechanisms: dict[tuple, Quantised]) -> tuple[float, float]:
    """Smallest and largest LDP output of the run's label mechanism."""
    if run.mechanism == "pm":
        a = piecewise.Piecewise(run.label_eps, run.t).a
        return -a, a
    lo, hi = (float(x) for x in mechanisms[catalog.lookup_key(run.obj, run.label_eps, run.label_n)].index_range)
    return lo, hi


def label_metadata(fitted: Fitted, runs: Sequence[Run], mechanisms: dict[tuple, Quantised] | None = None) -> list[dict]:
    """Inversion bounds of the runs that keep the LDP output as label."""
    ds = fitted.dataset
    s = fitted.stats.get(ds.label)
    out = []
    for run in runs:
        if run.mode != "index":
            continue
        if run.mechanism == "pm":
            lo, hi = label_bounds(run, {})
        elif mechanisms is not None:
            lo, hi = label_bounds(run, mechanisms)
        else:
            ends = quantised.signed_indices(run.label_n)
            lo, hi = float(ends[0]), float(ends[-1])
        out.append(
            {
                "dataset": ds.name,
                "mechanism": run.mechanism,
                "mode": run.mode,
                "eps": run.eps,
                "t": run.t,
                "n_outputs": run.n_outputs,
                "obj": run.obj,
                "label_eps": run.label_eps,
                "label_n": run.label_n,
                "seed": run.seed,
                "label_min": s.min,
                "label_max": s.max,
                "index_min": lo,
                "index_max": hi,
            }
        )
    return out
