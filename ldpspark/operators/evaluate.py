"""Evaluation per model: errors, accuracy, exact ROC-AUC, ROC points, Youden threshold, macro AUC.

Rank measures first collapse the rows to distinct scores (partial aggregation absorbs ties), then take prefix
sums over range slices; see ``ordered``. No row-level window over a whole model exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prefix_sums
from .profile import quoted

DEFAULT_THRESHOLD = 0.5


def rmse_mae(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    error = quoted(truth) - quoted(pred)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def accuracy(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = F.when(quoted(truth) == quoted(pred), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def score_counts(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, pos, neg) over distinct scores. Rows without score or truth are left out."""
    positive = (quoted(truth) == 1).cast("bigint")
    known = df.where(quoted(score).isNotNull() & quoted(truth).isNotNull())
    return known.groupBy(*keys, quoted(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(F.lit(1) - positive).alias("neg")
    )


def ranked_counts(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with the positives and negatives below each and in total."""
    counts = score_counts(df, truth, score, keys)
    return prefix_sums(counts, keys, [F.col("score").asc()], {"pos": "p", "neg": "n"})


def _auc() -> Column:
    """Aggregate over ranked counts: pairs won plus half the ties; NULL when a class is absent."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = pos * (F.col("n_before").cast("double") + neg / 2.0)
    pairs = F.first("p_all").cast("double") * F.first("n_all").cast("double")
    return F.sum(wins) / F.nullif(pairs, F.lit(0.0))


def _rates() -> tuple[Column, Column]:
    """False and true positive rate when the row's score is the threshold."""
    fpr = (F.col("n_all") - F.col("n_before")) / F.nullif(F.col("n_all"), F.lit(0))
    tpr = (F.col("p_all") - F.col("p_before")) / F.nullif(F.col("p_all"), F.lit(0))
    return fpr, tpr


def auc(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL when a class is absent."""
    return ranked_counts(df, truth, score, keys).groupBy(*keys).agg(_auc().alias("auc"))


def roc_points(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, fpr, tpr): one point per distinct score, and the point (0, 0) with an infinite
    threshold. A rate is NULL when its class is absent."""
    ranked = ranked_counts(df, truth, score, keys)
    fpr, tpr = _rates()
    points = ranked.select(*keys, F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    start = ranked.groupBy(*keys).agg(F.first("n_all").alias("n_all"), F.first("p_all").alias("p_all"))
    first = start.select(
        *keys,
        F.lit(float("inf")).alias("threshold"),
        F.when(F.col("n_all") > 0, F.lit(0.0)).alias("fpr"),
        F.when(F.col("p_all") > 0, F.lit(0.0)).alias("tpr"),
    )
    return points.unionByName(first)


def binary_report(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ("exp",)) -> DataFrame:
    """(keys, threshold, youden_j, accuracy, auc) per model, from one ranking.

    The threshold has the largest tpr - fpr, the highest one on ties; it is infinite when no score does better
    than calling everything negative, and 0.5 when one class is absent.
    """
    ranked = ranked_counts(df, truth, score, keys)
    fpr, tpr = _rates()
    total = F.col("p_all") + F.col("n_all")
    right = (F.col("p_all") - F.col("p_before") + F.col("n_before")) / total
    at_default = F.sum(F.when(F.col("score") >= DEFAULT_THRESHOLD, F.col("pos")).otherwise(F.col("neg")))
    best = F.max(F.struct((tpr - fpr).alias("j"), F.col("score").alias("threshold"), right.alias("right")))
    report = ranked.groupBy(*keys).agg(
        best.alias("b"),
        _auc().alias("auc"),
        F.first("p_all").alias("p_all"),
        F.first("n_all").alias("n_all"),
        (at_default / F.sum(F.col("pos") + F.col("neg"))).alias("default_right"),
    )
    curve = F.col("b.j").isNotNull()
    none = curve & (F.col("b.j") <= 0)
    return report.select(
        *keys,
        F.when(none, F.lit(float("inf"))).when(curve, F.col("b.threshold")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.when(none, F.lit(0.0)).otherwise(F.col("b.j")).alias("youden_j"),
        F.when(none, F.col("n_all") / total).when(curve, F.col("b.right")).otherwise(F.col("default_right")).alias("accuracy"),
        "auc",
    )


def youden(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr (see ``binary_report``)."""
    return binary_report(df, truth, score, keys).select(*keys, "threshold", "youden_j")


def unpivot_classes(df: DataFrame, truth: str, k: int, prefix: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """One row per (row, class): score and 0/1 truth of the class against the rest."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"{prefix}{c}").alias("score")) for c in range(k)])
    long = df.select(*keys, quoted(truth).alias("__t"), F.explode(pairs).alias("__s"))
    hit = F.when(F.col("__t") == F.col("__s.class"), 1).otherwise(0)
    return long.select(*keys, F.col("__s.class").alias("class"), F.col("__s.score").alias("score"), hit.alias("hit"))


def class_auc(df: DataFrame, truth: str, k: int, prefix: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """One-against-rest AUC per class; NULL for a class that has only one kind of label."""
    long = unpivot_classes(df, truth, k, prefix, keys)
    return auc(long, "hit", "score", [*keys, "class"])


def macro_auc(
    df: DataFrame, truth: str, k: int, prefix: str = "prob", keys: Sequence[str] = (), drop_unknown: bool = True
) -> DataFrame:
    """Mean of the defined class AUCs. ``drop_unknown`` leaves out rows whose true class is -1."""
    rows = df.where(quoted(truth) != -1) if drop_unknown else df
    return class_auc(rows, truth, k, prefix, keys).groupBy(*keys).agg(F.avg("auc").alias("auc_macro"))


# --------------------------------------------------------------------------- reports


def variant_name(mechanism: str) -> str:
    """``raw`` is ``Full``; ``pm_t3`` is ``LDP-PM(T3)``; ``qm`` is ``LDP-QM``."""
    if mechanism == "raw":
        return "Full"
    if "pm" in mechanism:
        name, t = mechanism.split("_t")
        return f"LDP-{name.upper()}(T{t})"
    return f"LDP-{mechanism.upper()}"


def variant_column(mechanism: str = "mechanism"):
    """The same naming on a column of mechanism keys."""
    m = F.col(mechanism)
    parts = F.split(m, "_t")
    pm = F.format_string("LDP-%s(T%s)", F.upper(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)))
    return F.when(m == "raw", F.lit("Full")).when(m.contains("pm"), pm).otherwise(F.concat(F.lit("LDP-"), F.upper(m)))


def rounded(df: DataFrame, column: str = "value", digits: int = 3) -> DataFrame:
    """Half-even rounding of a metric."""
    return df.withColumn(column, F.bround(column, digits))


def seed_means(scores: DataFrame, keys: Sequence[str] = ("variant", "metric")) -> DataFrame:
    """Round each seed's score, average over seeds (NULL-skipping), round again."""
    means = rounded(scores).groupBy(*keys).agg(F.avg("value").alias("value"))
    return rounded(means)


def wide_report(scores: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("variant",)) -> DataFrame:
    """One row per variant, one column per metric, sorted by variant."""
    return scores.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value")).orderBy(*keys)


def stack_metrics(df: DataFrame, keys: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for c, name in metrics.items()])
    return df.select(*keys, F.explode(pairs).alias("__m")).select(*keys, "__m.metric", "__m.value")


