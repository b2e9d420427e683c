"""Mixing sources to target weights.

Every source is cut into blocks by a keyed draw. A source's quota is so many whole passes over its blocks and a part of
one more: permuted blocks until the target is met, the last one document by document. The quotas are then split among
output shards by a tree: each node deals its blocks to two halves of fixed size without regard to the source, which
makes the sources' counts in each half multivariate hypergeometric while totals stay exact. Shards draw disjoint runs of
each source's permuted blocks, and rows are shuffled inside their shard.

All draws are md5 of (seed, stream, document), so reruns, retries and other partitionings agree. Tables of sources and
blocks are ranked in a window while they are small, and by slices of their order beyond; documents are never ranked as a
whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ldpspark.functions.rand import digest, draw
from ldpspark.operators.ordered import prefix_sums
from ldpspark.session import scratch_path, settle

# rows that one window may hold
MANY = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    seed: int = 0
    # blocks of a source, and parts of the block in which the quota ends
    blocks: int = 256
    parts: int = 1024
    # 2 ** depth output shards
    depth: int = 6
    # words that one partition of a shard should hold
    partition_words: int = 1 << 22


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def placed(docs: DataFrame, mix: Mix) -> DataFrame:
    """Adds the block ``__block`` and two draws of each document: its place in the block and in its shard. Rows with
    equal ``doc_id`` and text have equal draws and are taken together."""
    body = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), body)
    drawn = docs.withColumn("__digest", digest(mix.seed, "document", key))
    return drawn.withColumns(
        {
            "__block": F.floor(draw(F.col("__digest"), 0) * mix.blocks).cast("int"),
            "__place": draw(F.col("__digest"), 1),
            "__order": F.col("__digest"),
        }
    ).drop("__digest")


def targets(per_source: DataFrame, mix: Mix) -> DataFrame:
    """``(source, source_size)`` to ``source, source_size, target``: one row per source in all.

    The fixed point of sharing the excess of capped sources by weight, in one step: with sources in the order in which
    they reach their cap, those before the first uncapped one are full and the rest share what is left.
    """
    known = settle(per_source.withColumn("one", F.lit(1).cast("bigint")))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    placed = _before(known, [], [F.col("source").asc_nulls_last()], {"one": "n"})
    turn = F.pmod(F.col("n_before"), F.lit(len(mix.weights)))
    capped = placed.withColumns(
        {"weight": F.element_at(weights, turn.cast("int") + 1), "cap": F.col("source_size") * F.lit(float(mix.most))}
    )
    ratios = capped.withColumn("ratio", F.col("cap") / F.col("weight")).drop("n_before", "n_all")
    by_cap = [F.col("ratio"), F.col("source").asc_nulls_last()]
    summed = _before(ratios, [], by_cap, {"source_size": "size", "cap": "full", "weight": "heavy"})
    level = (F.col("size_all") * F.lit(float(mix.share)) - F.col("full_before")) / (F.col("heavy_all") - F.col("heavy_before"))
    levels = settle(summed.withColumn("level", level))
    # one number
    reached = levels.agg(F.max(F.when(F.col("ratio") > F.col("level"), F.col("level")))).first()[0]
    target = F.least("cap", F.lit(reached).cast("double") * F.col("weight"))
    return levels.select("source", "source_size", F.coalesce(target if reached is not None else F.col("cap"), "cap").alias("target"))


def _before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Adds ``<name>_before``, the sum over the rows before in the order, and ``<name>_all`` for each ``value -> name``. Few
    rows are ranked in a window, many by slices of the order; the sums are the same."""
    if df.count() > MANY:
        return prefix_sums(df, keys, order, sums)
    every = Window.partitionBy(*keys)
    earlier = every.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {f"{n}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v, n in sums.items()}
    return df.withColumns(added | {f"{n}_all": F.sum(v).over(every) for v, n in sums.items()})


def _join(left: DataFrame, right: DataFrame, on: dict[str, str] | None = None, how: str = "inner") -> DataFrame:
    """Join on ``source`` (NULL equals NULL) and further pairs of differently named columns."""
    match = F.col("source").eqNullSafe(F.col("__source"))
    for mine, theirs in (on or {}).items():
        match &= F.col(mine) == F.col(theirs)
    return left.join(right.withColumnRenamed("source", "__source"), match, how).drop("__source")


def _cut(groups: DataFrame, order: Sequence[str], room: str, half: bool = False) -> DataFrame:
    """Adds ``before``, and ``state`` of each group in its source's order: 1 fits, 0 holds the end of the room, -1 is
    beyond it. With ``half``, a group fits if most of it does, and none has state 0."""
    earlier = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(earlier), F.lit(0))
    seen = groups.withColumn("before", before)
    if half:
        return seen.withColumn("state", F.when(F.col("before") + F.col("words") / 2 <= F.col(room), 1).otherwise(-1))
    fits = F.col("before") + F.col("words") <= F.col(room)
    return seen.withColumn("state", F.when(fits, 1).when(F.col("before") < F.col(room), 0).otherwise(-1))


def block_plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """Placed documents with ``source, size`` to one row per source and block: ``source_size, target, passes`` (whole
    passes), ``upto`` (a document with a place up to it is drawn once more) and ``shards`` (one for each pass)."""
    blocks = settle(sized.groupBy("source", "__block").agg(F.sum("size").alias("words")))
    goal = settle(targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), mix))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumn("passes", passes).withColumn("room", F.col("target") - F.col("passes") * F.col("source_size"))

    name = F.concat_ws("-", F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull().cast("string"), "__block")
    known = _join(blocks, goal)
    known = settle(_cut(known.withColumn("turn", digest(mix.seed, "block", name)), ["turn"], "room"))

    # the block in which a source's room ends: its parts, then the documents of one part
    ends = known.where("state = 0").select("source", "__block", (F.col("room") - F.col("before")).alias("room"))
    ends = settle(ends.withColumnRenamed("__block", "end_block"))
    inside = _join(sized, ends, {"__block": "end_block"})
    part = F.floor(F.col("__place") * mix.parts)
    inside = settle(inside.select("source", "room", "size", "__place", part.alias("part")))
    parts = inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    last = _cut(parts, ["part"], "room").where("state = 0")
    last = settle(last.select("source", F.col("part").alias("end_part"), (F.col("room") - F.col("before")).alias("left")))
    tail = _join(inside, last, {"part": "end_part"})
    tail = tail.groupBy("source", "__place").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    taken = _cut(tail, ["__place"], "left", half=True).where("state = 1").groupBy("source").agg(F.max("__place").alias("upto"))
    stops = _join(last, taken, how="left").select(
        "source", F.coalesce("upto", F.col("end_part") / mix.parts - 2.0**-53).alias("upto")
    )
    known = _join(known, stops.withColumnRenamed("upto", "stop"), how="left")
    whole = F.when(F.col("state") == 1, 2.0).when(F.col("state") == 0, F.coalesce("stop", F.lit(-1.0))).otherwise(-1.0)
    known = settle(known.withColumn("upto", F.when(F.col("room") > 0, whole).otherwise(-1.0)))
    dealt = deal(known, mix)
    out = _join(known, dealt, {"__block": "block"}, "left")
    return out.select("source", "__block", "source_size", "target", "passes", "upto", "shards")


def deal(known: DataFrame, mix: Mix) -> DataFrame:
    """Drawn blocks to ``source, block, shards``: block quotas split down the tree, then runs of permuted blocks."""
    drawn = F.col("passes") + (F.col("upto") >= 0).cast("int")
    runs = known.where(drawn > 0).select(
        "source", F.col("__block").alias("block"), "turn", F.explode(F.sequence(F.lit(1), drawn)).alias("pass")
    )
    own = Window.partitionBy("source").orderBy("pass", "turn")
    permuted = runs.withColumn("number", F.row_number().over(own))
    name = F.concat_ws("-", F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull().cast("string"), "number")
    one = F.lit(1).cast("bigint").alias("one")
    tokens = settle(permuted.select("source", "number", F.lit(0).alias("shard"), one))
    for level in range(mix.depth):
        turned = tokens.withColumn("__turn", digest(mix.seed, f"level{level}", name))
        ranked = _before(turned, ["shard"], [F.col("__turn")], {"one": "n"})
        upper = 2 * (F.col("n_before") + 1) > F.col("n_all") + 1
        tokens = ranked.select("source", "number", (2 * F.col("shard") + upper.cast("int")).alias("shard"), "one")
    quota = Window.partitionBy("source").orderBy("shard", "number")
    slots = tokens.select(F.col("source"), "shard", F.row_number().over(quota).alias("slot"))
    matched = _join(permuted, slots, {"number": "slot"})
    return matched.groupBy("source", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards")
    )


def stored_plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """The block plan, read back from a file, so that its true size decides how it is joined."""
    path = scratch_path(sized.sparkSession, "mix")
    block_plan(sized, mix).write.parquet(path)
    return sized.sparkSession.read.parquet(path)


def planned(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (placed) with ``source_size, target`` and ``shards``, one for each copy to be taken."""
    plan = plan.select(
        F.col("source").alias("__source"),
        F.col("__block").alias("__b"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        *[F.col(c).alias(f"__{c}") for c in ("passes", "upto", "shards")],
    )
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__b"))
    copies = F.col("__passes") + (F.col("__place") <= F.col("__upto")).cast("int")
    shards = F.when(copies > 0, F.slice("__shards", 1, copies)).otherwise(F.array().cast("array<int>"))
    joined = docs.join(plan, on).withColumn("__shards", shards)
    return joined.drop("__source", "__b", "__passes", "__upto")


def mix_counts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, shards``.

    A NULL text has size 0; a NULL source is a source of its own, the last one. A document of size 0 takes no words
    however often it is drawn. Rows with equal ``doc_id`` and text are drawn together; columns other than ``doc_id,
    text, source`` are not read. No documents give no rows.
    """
    seen = placed(docs.select("doc_id", "text", "source"), mix)
    sized = settle(seen.select("doc_id", "source", n_words().alias("size"), "__block", "__place"))
    out = planned(sized, stored_plan(sized, mix))
    return out.select(
        "doc_id",
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("size") * F.size("__shards")).alias("taken"),
        F.col("__shards").alias("shards"),
    )


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: documents not drawn are left out, others come once or twice. A
    shard is shuffled inside, in as many partitions as its words need."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    seen = placed(docs.select("doc_id", "text", "source"), mix)
    sized = settle(seen.select("doc_id", "source", n_words().alias("size"), "__block", "__place"))
    rows = placed(docs.select("doc_id", "text", "source", row), mix).drop("doc_id", "text")
    plan = stored_plan(sized, mix)
    words = plan.groupBy("source").agg(F.max("target").alias("target")).agg(F.sum("target")).first()[0] or 0
    parts = max(1, math.ceil(words / (mix.partition_words << mix.depth)))
    drawn = planned(rows, plan).select("__row", "__order", F.posexplode("__shards").alias("__pass", "__shard"))
    order = F.md5(F.concat_ws("|", F.lit(f"{mix.seed}|shuffle"), "__order", F.col("__pass").cast("string")))
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    dealt = drawn.withColumns({"__order": order, "__part": part}).repartition(parts << mix.depth, "__shard", "__part")
    return dealt.sortWithinPartitions("__shard", "__order").select(
        *[F.col("__row").getField(c).alias(c) for c in names]
    )
