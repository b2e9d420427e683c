"""Hard-negative mining by threshold joins over an inverted index.

An anchor asks for the best rows inside score windows. Rows are dealt into blocks of bounded size; a task holds one block as
an inverted index and lets the anchors stream past it. With a threshold, a row need only be listed under its strongest
dimensions: the rest is left out where the suffix norms of row and anchors prove that it cannot reach the threshold alone.
Partial scores are added up list by list, rows are pruned when the remaining norms cannot lift any anchor over its
threshold, and the survivors are completed. A threshold starts high and is lowered until an anchor's windows are full.

Two passes make a search: a pilot over about the square root of the blocks yields scores that the final windows reach in
any case, and all blocks are then asked with these as thresholds. Both are exact, so the pilot decides only the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ldpspark.session import settle

# dimensions of one list, and anchors scored at once
LIST = 16
TILE = 128
# thresholds to try, as shares of the largest score that norms allow; the floor of the windows comes last
LEVELS = (0.5, 0.25, 0.125, 0.0625)


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    # a negative's score lies between these percentages of the positive's
    low: int = 80
    high: int = 100
    # components are floored to this fraction of one
    scale: int = 256
    rows: int = 16_384


# ------------------------------------------------------------------ one block


class Index:
    """Rows of a block, strongest dimensions first, with the norms of what follows each list."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.order = np.argsort(-(vectors * vectors).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.order]
        self.cuts = list(range(0, vectors.shape[1], LIST))
        self.rest = rest_norms(self.vectors, self.cuts)
        self.norm = float(self.rest[:, 0].max())

    def reach(self, anchors: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rows kept, scores)``: exact scores of all anchors with every row among ``rows`` that some anchor
        scores ``least`` or more with."""
        rest = rest_norms(anchors, self.cuts)
        # rounding of the norms; scores are whole numbers
        slack = 0.5 + 1e-12 * rest[:, 0].max() * self.norm
        wanted = (least - slack)[:, None]
        # lists a row is in: those before the first suffix that no anchor can reach its threshold with
        enough = self.rest[rows] * rest.max(axis=0)[None, :] >= wanted.min()
        listed = enough.sum(axis=1)
        some = np.nonzero(listed)[0]
        some = some[np.argsort(-listed[some], kind="stable")]
        rows, listed = rows[some], listed[some]
        scores = np.zeros((len(anchors), len(rows)))
        for k, cut in enumerate(self.cuts):
            n = int(np.searchsorted(-listed, -k, "left"))
            if not n:
                break
            dims = slice(cut, cut + LIST)
            scores[:, :n] += anchors[:, dims] @ self.vectors[rows[:n], dims].T
            seen = np.minimum(listed, k + 1)
            alive = (scores + rest[:, seen] * self.rest[rows, seen][None, :] >= wanted).any(axis=0)
            if alive.mean() < 0.8:
                rows, listed, scores = rows[alive], listed[alive], scores[:, alive]
        for k, cut in enumerate(self.cuts):
            # complete what the lists left out
            n = int(np.searchsorted(-listed, -k, "left"))
            dims = slice(cut, cut + LIST)
            if n < len(rows):
                scores[:, n:] += anchors[:, dims] @ self.vectors[rows[n:], dims].T
        return rows, scores


def rest_norms(vectors: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what starts at each cut, and 0 behind the last."""
    squares = np.add.reduceat(vectors * vectors, cuts, axis=1)
    tail = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tail, np.zeros((len(vectors), 1))], axis=1))


@dataclass
class Asked:
    """Anchors with windows ``low[anchor, window] <= score <= high[anchor, window]``; each wants its first ``k`` rows, of
    the anchor's label or of all others."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool


def best_in_block(index: Index, asked: Asked) -> Iterator[tuple[int, int, int, float]]:
    """``(anchor row, window, vec_id, score)``: the first ``k`` rows of the block in every window."""
    vectors = asked.vectors[:, index.order]
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    groups = [np.nonzero(asked.labels == label)[0] for label in np.unique(asked.labels)] if asked.same else [np.arange(len(vectors))]
    for group in groups:
        rows = np.nonzero(index.labels == asked.labels[group[0]])[0] if asked.same else np.arange(len(index.ids))
        for first in range(0, len(group), TILE):
            open_ = group[first : first + TILE]
            for level in (*LEVELS, None):
                floor = asked.low[open_].min(axis=1)
                least = floor if level is None else np.maximum(floor, level * norms[open_] * index.norm)
                kept, scores = index.reach(vectors[open_], least, rows)
                more = []
                for n, anchor in enumerate(open_):
                    at = np.nonzero(scores[n] >= least[n])[0]
                    row = kept[at]
                    fits = index.ids[row] != asked.ids[anchor]
                    if not asked.same:
                        fits &= index.labels[row] != asked.labels[anchor]
                    row, score = row[fits], scores[n, at[fits]]
                    found = _windows(index.ids[row], score, asked.low[anchor], asked.high[anchor], asked.k)
                    if least[n] > floor[n] and any(len(w) < asked.k for w in found):
                        more.append(anchor)
                        continue
                    for window, some in enumerate(found):
                        for i in some:
                            yield anchor, window, int(index.ids[row[i]]), float(score[i])
                open_ = np.array(more, dtype=np.int64)
                if not len(open_):
                    break


def _windows(ids: np.ndarray, scores: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the first ``k`` in each window, by score and then id."""
    out = []
    for lo, hi in zip(low, high):
        at = np.nonzero((scores >= lo) & (scores <= hi))[0]
        if len(at) > k:
            # all that tie with the k-th stay for the sort
            at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
        out.append(at[np.lexsort((ids[at], -scores[at]))[:k]])
    return out


# ------------------------------------------------------------------ Spark


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, dim, vector`` of the rows that take part, one for each ``vec_id``; the vector is packed."""
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    seen = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    kind = seen.select("vec_id", "label").schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            with np.errstate(over="ignore"):
                # the largest double stands for what the scale lifts beyond it
                floored = np.clip(np.floor(values * scale), -np.finfo(float).max, np.finfo(float).max) + 0.0
            cells = [floored[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(np.diff(at), pa.int32()), pa.array(cells, pa.binary())],
                ["vec_id", "label", "dim", "vector"],
            )

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    packed = seen.select("vec_id", "label", whole.alias("embedding")).mapInArrow(pack, f"{types}, dim int, vector binary")
    one = packed.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vector")).alias("r"))
    return one.select("vec_id", "r.*").where("dim > 0")


def ask(rows: DataFrame, asks: DataFrame, blocks: int, k: int, same: bool, pilot: bool) -> DataFrame:
    """``(anchor_id, window, vec_id, score)``: the first ``k`` rows of every window in each block that was asked.

    ``asks`` has the columns of ``rows`` and ``low`` and ``high``, arrays with one entry per window. A pilot asks about
    the square root of the blocks, other ones for each anchor in turn.
    """
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    some = int(np.ceil(np.sqrt(blocks))) if pilot else blocks
    steps = F.explode(F.sequence(F.lit(0), F.lit(some - 1)))
    empty = F.lit(None).cast("array<double>")
    base = rows.select(block.alias("block"), "dim", F.lit(0).alias("side"), "vec_id", "label", "vector", empty.alias("low"), empty.alias("high"))
    asking = asks.withColumn("step", steps).select(
        F.pmod(block + F.col("step"), F.lit(blocks)).cast("int").alias("block"), "dim", F.lit(1).alias("side"), "vec_id", "label", "vector", "low", "high"
    )
    label_kind = rows.schema["label"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index = None, [], None
        for batch in batches:
            block, dim, side = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
            turns = np.nonzero((np.diff(block) != 0) | (np.diff(dim) != 0) | (np.diff(side) != 0))[0] + 1
            for start, end in zip([0, *turns], [*turns, len(block)]):
                if start == end:
                    continue
                part, here = batch.slice(start, end - start), (block[start], dim[start])
                if here != place:
                    place, held, index = here, [], None
                if side[start] == 0:
                    held.append(_columns(part, here[1]))
                    continue
                if not held and index is None:
                    # no row of this dimension fell into the block
                    continue
                if index is None:
                    index, held = Index(*(np.concatenate(x) for x in zip(*held))), []
                ids, labels, vectors = _columns(part, here[1])
                low, high = (np.array(part.column(n).to_pylist(), float) for n in (6, 7))
                found = list(best_in_block(index, Asked(ids, labels, vectors, low, high, k, same)))
                if found:
                    anchor, window, vec_id, score = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[list(anchor)], pa.int64()), pa.array(window, pa.int32()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())],
                        ["anchor_id", "window", "vec_id", "score"],
                    )

    dealt = base.withColumn("label", F.col("label").cast(label_kind)).unionByName(asking)
    # a block is one group of bounded size; the anchors stream past it
    dealt = dealt.repartition(blocks, "block", "dim").sortWithinPartitions("block", "dim", "side")
    return dealt.mapInArrow(meet, "anchor_id bigint, window int, vec_id bigint, score double")


def _columns(part: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(-1, dim)
    return part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False), vectors


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each window, with their ``rank``."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def two_passes(rows: DataFrame, asks: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """``(anchor_id, window, rank, vec_id, score)`` over all blocks."""
    if blocks > 2:
        pilot = first_of(ask(rows, asks, blocks, k, same, True), k)
        # where the pilot filled a window, its last score is one that the result reaches
        last = pilot.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("m"))
        last = settle(last.withColumnRenamed("anchor_id", "__anchor"))
        raised = F.transform("low", lambda low, n: F.greatest(low, F.coalesce(F.element_at("m", n), low)))
        asks = asks.join(last, F.col("vec_id") == F.col("__anchor"), "left").withColumn("low", raised).drop("m", "__anchor")
        asks = settle(asks)
    return first_of(ask(rows, asks, blocks, k, same, False), k)


def mine(vectors: DataFrame, is_anchor: Column, spec: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    ``vectors`` has an integer ``vec_id``, ``label`` and ``embedding``; ``is_anchor`` may use ``vec_id`` and ``label``. Components
    become whole multiples of ``1 / scale`` (floored), a score is their inner product, as a double, so exact below 2**53
    and held to the range of a long. Positives are the first ``positives`` other rows of the anchor's label, by score and
    then smaller ``vec_id``; negatives the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    per cent of the positive's. Fewer rows give fewer results, a positive without negatives none.

    Rows without ``vec_id``, label or vector, with an empty vector, or with a NULL or non-finite component take no part. Of
    several rows with one ``vec_id`` the least (label, length, packed vector) takes part. Vectors of different length never
    meet. Other columns are not read.
    """
    rows = settle(usable(vectors.select("vec_id", "label", "embedding"), spec.scale).withColumn("vec_id", F.col("vec_id").cast("bigint")))
    blocks = max(1, -(-rows.count() // spec.rows))
    anchors = settle(rows.where(is_anchor))
    endless = lambda sign: F.array(F.lit(float(f"{sign}inf")))
    asks = anchors.withColumns({"low": endless("-"), "high": endless("+")})
    whole = lambda c: F.round(c).cast("bigint")
    best = two_passes(rows, asks, blocks, spec.positives, True)
    # at most ``positives`` entries an anchor
    windows = best.groupBy(F.col("anchor_id").alias("__anchor")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("w"))
    windows = settle(windows)
    bound = lambda percent, to: F.transform("w", lambda w: to(w["score"] * percent / 100).cast("double"))
    asks = settle(
        anchors.join(windows, F.col("vec_id") == F.col("__anchor")).drop("__anchor")
        # every anchor has as many windows, those beyond its positives are empty
        .withColumns({"low": bound(spec.low, F.ceil), "high": bound(spec.high, F.floor)})
        .withColumns({c: F.concat(c, F.array_repeat(F.lit(v), F.lit(spec.positives) - F.size("w"))) for c, v in (("low", float("inf")), ("high", float("-inf")))})
    )
    found = two_passes(rows, asks.drop("w"), blocks, spec.negatives, False)
    named = found.join(windows, F.col("anchor_id") == F.col("__anchor")).withColumn("p", F.col("w")[F.col("window")])
    return named.select(
        "anchor_id",
        F.col("p.vec_id").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        whole(F.col("p.score")).alias("positive_score"),
        whole(F.col("score")).alias("negative_score"),
    )
