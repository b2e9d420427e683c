"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines of a document are hashed. A window that occurs more than once in the corpus stays where
it comes first (by ``doc_id``, then place in the document); its later occurrences cover their three lines, and covered
lines are removed. Single common lines stay: only passages of three lines or more repeat by intent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldpspark.session import settle

WINDOW = 3


def lines_of(text: str | Column = "text") -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """``doc_id, __text, at, window``: place (from 0) and 128-bit hash of each window. Windows of blank lines only
    are left out: they are spacing, not a passage."""
    n = F.size("__lines")
    joined = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.concat_ws("\n", *[F.element_at("__lines", i + k + 1) for k in range(WINDOW)]),
    )
    cut = docs.select("doc_id", F.xxhash64("text").alias("__text"), lines_of().alias("__lines")).where(n >= WINDOW)
    placed = cut.select("doc_id", "__text", F.posexplode(joined).alias("at", "body"))
    return placed.where(F.regexp_like("body", F.lit(r"[^\x20\x09-\x0D]"))).select(
        "doc_id", "__text", "at", F.unhex(F.md5("body")).alias("window")
    )


def place() -> Column:
    """Order of occurrences as one number, so that the first one is found by a hash aggregate: ``doc_id`` (NULL before
    all others), then the place in the document."""
    least = F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), least) * F.lit(2**31).cast("decimal(10,0)") + F.col("at")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, __text, at`` of every later occurrence of a window."""
    found = windows(docs).withColumn("place", place().cast("decimal(38,0)"))
    first = found.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    first = settle(first.where("n > 1").select(F.col("window").alias("__window"), "first"))
    later = found.join(first, F.col("window") == F.col("__window"))
    return later.where(F.col("place") > F.col("first")).select("doc_id", "__text", "at")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences cut out of ``text``, and ``n_lines``, ``n_removed``.

    ``doc_id`` is an integer. A text without a repeat, a NULL text and a text of fewer than three lines stay as they
    are. A text may become empty; its row stays. Rows with the same ``doc_id`` count as one document: the same window
    at the same place of two of them is one occurrence. Other columns pass through; ``n_lines`` and ``n_removed``
    replace columns of that name.
    """
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda i: F.sequence(i, i + WINDOW - 1))))
    cuts = repeats(docs.select("doc_id", "text")).groupBy("doc_id", "__text").agg(covered.alias("__covered"))
    cuts = settle(cuts.select(F.col("doc_id").alias("__doc"), F.col("__text").alias("__body"), "__covered"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("__hash"))
    on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__body"))
    joined = keyed.join(cuts, on, "left").withColumn("__lines", lines_of())
    # indexes before lines: array_except keeps the order of the first array
    kept = F.array_except(F.sequence(F.lit(1), F.size("__lines")), F.transform("__covered", lambda i: i + 1))
    text = F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i)), "\n")
    text = F.when(F.col("__covered").isNull(), F.col("text")).otherwise(text).alias("text")
    return joined.select(
        *[text if c == "text" else F.col(f"`{c}`") for c in names],
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__covered"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns and the repeated passages cut out of ``text``."""
    extra = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    if extra:
        packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
        cut = dedup_lines(packed)
        return cut.select(*[F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])
    return dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
