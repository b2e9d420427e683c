"""Categories: sorted distinct values, ordinal codes, one-hot columns, class and label priors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import global_row_number
from .profile import quoted

PRIOR_FLOOR = 1e-9

# Up to this many categories become literals in the expression; more go through a join.
LITERAL_CATEGORIES = 256


@dataclass
class Categories:
    """Sorted distinct values of a column with 0-based codes.

    ``values`` is set while they are few; ``table`` (value, code) always.
    """

    table: DataFrame
    size: int
    values: list | None

    def listed(self) -> list:
        """The values in order, for results that name each of them in their schema."""
        if self.values is None:
            self.values = [r[0] for r in self.table.orderBy("code").select("value").collect()]
        return self.values


def categories(df: DataFrame, column: str, where: Column | None = None) -> Categories:
    """Distinct non-NULL values (of the train rows) in order."""
    source = df if where is None else df.where(where)
    distinct = source.where(quoted(column).isNotNull()).select(quoted(column).alias("value")).distinct()
    head = sorted(r[0] for r in distinct.limit(LITERAL_CATEGORIES + 1).collect())
    if len(head) <= LITERAL_CATEGORIES:
        spark = df.sparkSession
        schema = f"value {df.schema[column].dataType.simpleString()}, code bigint"
        table = spark.createDataFrame([(v, i) for i, v in enumerate(head)], schema)
        return Categories(table, len(head), head)
    numbered = global_row_number(distinct, [F.col("value")], "code")
    return Categories(numbered, numbered.count(), None)


def ordinal_encode(df: DataFrame, column: str, cats: Categories, output: str, unknown: int | None = -1) -> DataFrame:
    """Add the code, a bigint; a value unseen in train gets ``unknown``."""
    missing = F.lit(unknown).cast("bigint")
    if cats.values is not None:
        if not cats.values:
            return df.withColumn(output, missing)
        known = F.array(*[F.lit(v) for v in cats.values])
        found = F.array_position(known, quoted(column)) - 1
        return df.withColumn(output, F.coalesce(F.when(found >= 0, found), missing))
    side = cats.table.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    joined = df.join(side, quoted(column) == F.col("__v"), "left")
    return joined.select(*[quoted(c) for c in df.columns], F.coalesce("__c", missing).alias(output))


def decode(df: DataFrame, code: str, cats: Categories, output: str) -> DataFrame:
    """Code back to category. With a join, codes are spread evenly by construction of the codes."""
    if cats.values is not None:
        known = F.array(*[F.lit(v) for v in cats.values])
        return df.withColumn(output, F.get(known, quoted(code)))
    side = cats.table.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    joined = df.join(side, quoted(code) == F.col("__c"), "left")
    return joined.select(*[quoted(c) for c in df.columns], F.col("__v").alias(output))


def unknown_values(df: DataFrame, column: str, cats: Categories) -> DataFrame:
    """Distinct values with no code; a caller that must not meet any checks that this is empty."""
    side = cats.table.select(F.col("value").alias("__v"))
    present = df.where(quoted(column).isNotNull())
    return present.join(side, quoted(column) == F.col("__v"), "left_anti").select(column).distinct()


def one_hot(df: DataFrame, code: str, k: int, prefix: str) -> DataFrame:
    """K columns of 0/1."""
    hot = [F.when(quoted(code) == i, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{prefix}{i}") for i in range(k)]
    return df.select("*", *hot)


def one_hot_categorical(df: DataFrame, columns: Sequence[str], fitted: dict[str, Categories]) -> DataFrame:
    """One 0/1 column per train category, named ``column_value``; unseen values give zeros everywhere.

    The result has a column per category whatever their number; ``one_hot_sparse`` suits many.
    """
    hot = []
    for c in columns:
        values = fitted[c].listed()
        hot += [F.when(quoted(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}") for v in values]
    kept = [quoted(c) for c in df.columns if c not in set(columns)]
    return df.select(*kept, *hot)


def one_hot_sparse(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fitted: dict[str, Categories]) -> DataFrame:
    """The ones of the one-hot form: (keys, column, code), one row per row and column with a known category.

    Any number of categories: codes come from ``ordinal_encode``, and the row count does not depend on them.
    """
    coded = df.select(*[quoted(c) for c in dict.fromkeys([*keys, *columns])])
    for c in columns:
        coded = ordinal_encode(coded, c, fitted[c], f"__hot_{c}", unknown=None)
    ones = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`__hot_{c}`").alias("code")) for c in columns])
    long = coded.select(*[quoted(c) for c in keys], F.explode(ones).alias("__one"))
    return long.select(*[quoted(c) for c in keys], "__one.column", "__one.code").where(F.col("code").isNotNull())


def class_log_priors(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(class, log of the clipped proportion): start value of the softmax biases."""
    counts = df.groupBy(*keys, quoted(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # one row per class (and key): the window runs over the counts, not over the data
    total = F.sum("n").over(Window.partitionBy(*keys))
    joined = counts.withColumn("total", total)
    share = F.least(F.greatest(F.col("n") / F.col("total"), F.lit(PRIOR_FLOOR)), F.lit(1 - PRIOR_FLOOR))
    return joined.select(*keys, "class", share.alias("proportion"), F.log(share).alias("log_prior"))


def label_priors(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Label mean and clipped log-odds: start values of the linear and the logistic bias."""
    mean = F.avg(quoted(label).cast("double"))
    p = F.least(F.greatest(F.col("label_mean"), F.lit(PRIOR_FLOOR)), F.lit(1 - PRIOR_FLOOR))
    means = df.groupBy(*keys).agg(mean.alias("label_mean"))
    return means.withColumn("log_odds", F.log(p / (F.lit(1.0) - p)))
