"""Row identity, train/test split and mini-batch assignment, all by keyed hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permute import constants, permute, whole
from ..functions.rand import digest, draw

TEST_SIZE = 0.2
RANDOM_STATE = 42
SPLIT_STREAM = "split"

# Hex digits of a row's digest, and by how many of them one pass of an exact split narrows the cut.
DIGEST_DIGITS = 32
CUT_DIGITS = 5

# Rows that one rank window may hold; sets how many hash buckets a rank uses.
BUCKET_ROWS = 1_000_000


def split_digest(key: Column, random_state: int = RANDOM_STATE, salt: str = "") -> Column:
    return digest(random_state, SPLIT_STREAM, key, "", salt)


def is_test(key: Column, test_size: float = TEST_SIZE, random_state: int = RANDOM_STATE, salt: str = "") -> Column:
    return draw(split_digest(key, random_state, salt)) < F.lit(float(test_size))


def hash_split(
    df: DataFrame, key: Column, test_size: float = TEST_SIZE, random_state: int = RANDOM_STATE, salt: str = ""
) -> DataFrame:
    """Add ``split``. A projection: no shuffle, and the same rows for every seed, budget and mechanism."""
    return df.withColumn(
        "split", F.when(is_test(key, test_size, random_state, salt), F.lit("test")).otherwise(F.lit("train"))
    )


def prefix_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits d such that rows / 16^d buckets are below the bucket size."""
    digits = 1
    while rows / 16**digits > bucket_rows:
        digits += 1
    return digits


def exact_cut(
    df: DataFrame, key: Column, test_size: float = TEST_SIZE, random_state: int = RANDOM_STATE, salt: str = ""
) -> str | None:
    """Upper bound of the test digests of an exact-size split: the ceil(test_size * rows) smallest ones.

    Rows are counted per hash prefix, then per longer prefix inside the one that holds the cut, until the cut falls
    between two prefixes. No row is ordered, a pass yields at most 16^CUT_DIGITS counts, and two passes serve a
    million million rows. Keys that are not unique may have no such cut, which is an error.
    """
    hashed = df.select(split_digest(key, random_state, salt).alias("h"))
    prefix, wanted = "", None
    while len(prefix) < DIGEST_DIGITS:
        inside = hashed.where(F.col("h").startswith(prefix)) if prefix else hashed
        counts = inside.groupBy(F.substring("h", 1, len(prefix) + CUT_DIGITS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        total = F.sum("n").over(Window.partitionBy())
        running = counts.select("b", "n", F.sum("n").over(Window.orderBy("b")).alias("upto"), total.alias("total"))
        # the first pass knows the size of the table as well
        goal = F.ceil(F.col("total") * F.lit(float(test_size))) if wanted is None else F.lit(wanted)
        at = running.withColumn("goal", goal).where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal"))).head()
        if at is None:
            return None
        if at["upto"] == at["goal"]:
            # sorts behind every digest that starts with the prefix
            return at["b"] + "g"
        prefix, wanted = at["b"], at["goal"] - (at["upto"] - at["n"])
    raise ValueError("rows with equal keys lie on both sides of the cut: the keys of an exact split must be unique")


def exact_split(
    df: DataFrame, key: Column, test_size: float = TEST_SIZE, random_state: int = RANDOM_STATE, salt: str = ""
) -> DataFrame:
    """Add ``split`` with exactly ceil(test_size * rows) test rows. The rows themselves are not shuffled."""
    cut = exact_cut(df, key, test_size, random_state, salt)
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    test = split_digest(key, random_state, salt) <= F.lit(cut)
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def assign_batches(
    df: DataFrame,
    key: Column,
    batch_size: int,
    epochs: int | Sequence[int] = 1,
    seed: int | Column = 0,
    *,
    rows: int | None = None,
    partition: list[str] | None = None,
    salt: str = "",
) -> DataFrame:
    """One row per (row, epoch) with ``epoch`` and ``batch_id``; the incomplete last batch is left out.

    The order of an epoch is the order of the epoch's digests. Rank = rows in earlier hash buckets + rank
    inside the bucket, so a window never holds more than about ``BUCKET_ROWS`` rows. ``batch_size <= 0``
    gives one batch with everything. ``partition`` ranks separately per group (one group per model). A list of
    ``epochs`` asks for these alone.
    """
    group = list(partition or [])
    wanted = list(range(epochs)) if isinstance(epochs, int) else list(epochs)
    each = df.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in wanted]))) if wanted else None
    if each is None:
        return df.limit(0).withColumn("epoch", F.lit(0)).withColumn("batch_id", F.lit(0).cast("bigint"))
    if batch_size <= 0:
        return each.withColumn("batch_id", F.lit(0).cast("bigint"))
    digits = prefix_digits(df.count() if rows is None else rows)
    stream = F.concat(F.lit("epoch"), F.col("epoch").cast("string"))
    hashed = each.withColumn("__h", digest(seed, stream, key, "", salt))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, digits))
    counts = hashed.groupBy(*group, "epoch", "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_epoch = Window.partitionBy(*group, "epoch")
    earlier = by_epoch.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        "epoch",
        "__b",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"),
        F.sum("__n").over(by_epoch).alias("__all"),
    )
    inside = Window.partitionBy(*group, "epoch", "__b").orderBy("__h")
    ranked = hashed.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, [*group, "epoch", "__b"])
    batch = F.floor((F.col("__r") + F.col("__off")) / F.lit(batch_size)).cast("bigint")
    full = F.floor(F.col("__all") / F.lit(batch_size))
    return (
        ranked.withColumn("batch_id", batch)
        .where(F.col("batch_id") < full)
        .select(*df.columns, "epoch", "batch_id")
    )


def hash_ranks(
    df: DataFrame, key: Column, *, rows: int | None = None, partition: list[str] | None = None, salt: str = ""
) -> DataFrame:
    """Add ``__rank``, the 0-based place of a row in the order of its digest, and ``__all``, the rows of its group.

    The rows are exchanged once, by hash bucket. Keys must be unique: equal ones have no order of their own.
    """
    group = list(partition or [])
    digits = prefix_digits(df.count() if rows is None else rows)
    hashed = df.withColumn("__h", digest("", "rank", key, "", salt)).withColumn("__b", F.substring("__h", 1, digits))
    counts = hashed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        "__b",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"),
        F.sum("__n").over(whole).alias("__all"),
    )
    inside = Window.partitionBy(*group, "__b").orderBy("__h")
    ranked = hashed.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, [*group, "__b"])
    return ranked.select(*df.columns, (F.col("__r") + F.col("__off")).alias("__rank"), "__all")


def permuted_batches(
    df: DataFrame,
    key: Column,
    batch_size: int,
    epochs: int = 1,
    seed: int = 0,
    *,
    rows: int | None = None,
    partition: list[str] | None = None,
    salt: str = "",
) -> DataFrame:
    """The same result form as ``assign_batches``, with one exchange whatever the number of epochs.

    Rows are ranked once; each epoch's order is a keyed permutation of the ranks, found by arithmetic. With a narrow
    ``df`` (the key) this is a list of batches; training keeps its rows once and computes the place in each epoch.
    The incomplete last batch of an epoch is left out; ``batch_size <= 0`` gives one batch with everything.
    """
    if epochs <= 0:
        return df.limit(0).withColumn("epoch", F.lit(0)).withColumn("batch_id", F.lit(0).cast("bigint"))
    numbered = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    if batch_size <= 0:
        return df.withColumn("epoch", numbered).withColumn("batch_id", F.lit(0).cast("bigint"))
    ranked = hash_ranks(df, key, rows=rows, partition=partition, salt=salt).withColumn("epoch", numbered)
    return in_batches(ranked, batch_size, [constants(seed, e, salt) for e in range(epochs)]).select(*df.columns, "epoch", "batch_id")


def in_batches(ranked: DataFrame, batch_size: int, keys: list[list[int]], turn: Column | None = None) -> DataFrame:
    """Add ``batch_id`` to rows of ``hash_ranks``: permutation ``turn`` (the epoch, if not given) cut into whole batches."""
    turn = F.col("epoch") if turn is None else turn
    place = permute(F.col("__rank"), F.col("__all"), turn, keys)
    batched = ranked.withColumn("batch_id", whole(place, batch_size))
    return batched.where(F.col("batch_id") < whole(F.col("__all").cast("bigint"), batch_size))
