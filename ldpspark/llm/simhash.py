"""SimHash near-duplicates with vantage-point trees.

Documents become 64-bit fingerprints; equal fingerprints collapse first, so a group of copies of any size is one
point. A vantage-point tree, fitted on a bounded sample, cuts the points into shards by Hamming distance. A point
just outside a ball also goes inside, which puts both ends of every close pair into one shard. Shards are searched
exactly, pruning with the triangle bound, and each returns a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldpspark.session import settle

from .graph import components

SEED = 42
SHINGLE = 3
RADIUS = 2
# points a shard should hold, before the overlap
SHARD = 1024
# bounds of what the driver fits and sends to the executors: 64 Ki leaves, 16 sample points for each
MAX_LEAVES = 1 << 16
SAMPLE_PER_LEAF = 16
# values of the hash that draws the sample
DRAWS = 1 << 40
# a shard above this size is searched in pairs of blocks
MAX_SHARD = 1 << 17
# below this size all distances of a shard are taken
BRUTE = 512
# hashes held at once while the bits of one text are counted
HASHES = 1 << 16


# ------------------------------------------------------------------ fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, HASHES):
        part = words[start : start + HASHES + shingle - 1]
        grams = zip(*[part[k:] for k in range(shingle)])
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the fingerprint of ``text`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(prints, pa.int64())], [*keep, name])

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{types}, {name} bigint")


# ------------------------------------------------------------------ the tree


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in heap order; a node without a split has radius 64: all points go inside."""

    vantage: np.ndarray
    radius: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, seed: int = 0) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        vantage = np.zeros((1 << depth) - 1, np.uint64)
        radius = np.full((1 << depth) - 1, 64, np.uint8)
        rng = np.random.default_rng(seed)
        subsets = {0: sample}
        for node in range(len(radius)):
            points = subsets.pop(node, sample[:0])
            if len(points) < 8:
                continue
            best = None
            for v in points[rng.integers(0, len(points), 8)]:
                d = np.bitwise_count(points ^ v)
                for r in {int(np.median(d)) + k for k in (-2, -1, 0, 1)}:
                    inside = (d <= r).mean()
                    if 0.25 <= inside <= 0.75:
                        shell = ((d > r) & (d <= r + RADIUS)).mean()
                        score = shell + abs(inside - 0.5) / 4
                        if best is None or score < best[0]:
                            best = (score, v, r, d)
            if best is not None:
                _, vantage[node], radius[node], d = best
                subsets[2 * node + 1], subsets[2 * node + 2] = points[d <= radius[node]], points[d > radius[node]]
        return cls(vantage, radius, depth)

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves. For a pair that a ball separates, d(outer) <= radius + RADIUS by the triangle
        bound, so it is enough that points of this shell go to both sides."""
        rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(points[rows] ^ self.vantage[nodes]).astype(np.int64)
            r = self.radius[nodes].astype(np.int64)
            outer = d > r
            both = outer & (d <= r + RADIUS)
            rows, nodes = np.concatenate([rows, rows[both]]), np.concatenate([2 * nodes + 1 + outer, 2 * nodes[both] + 1])
        return rows, nodes - ((1 << self.depth) - 1)


# ------------------------------------------------------------------ one shard


class Forest:
    """Union-find over row numbers; pairs are merged in batches."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pending.append((i, j))
        self.size += len(i)
        if self.size > 1 << 20:
            self.merge()

    def merge(self) -> np.ndarray:
        if self.pending:
            i, j = (np.concatenate(x) for x in zip(*self.pending))
            self.pending, self.size = [], 0
            while len(i):
                a, b = self.label[i], self.label[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
                while (self.label != self.label[self.label]).any():
                    self.label = self.label[self.label]
        return self.label


def near_masks(radius: int = RADIUS) -> np.ndarray:
    """All differences of 1 to ``radius`` (at most 2) bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    if radius < 2:
        return one
    i, j = np.triu_indices(64, 1)
    return np.concatenate([one, one[i] | one[j]])


def _search(points: np.ndarray, rows: np.ndarray, forest: Forest) -> None:
    if len(rows) <= BRUTE:
        own = points[rows]
        i, j = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS, 1))
        forest.add(rows[i], rows[j])
        return
    d = np.bitwise_count(points[rows] ^ points[rows[len(rows) // 2]]).astype(np.int64)
    r = int(np.median(d))
    inner, outer = rows[d <= r + RADIUS], rows[d > r]
    if max(len(inner), len(outer)) > 0.9 * len(rows):
        # distances do not tell these points apart: look up every neighbour in the sorted points instead
        own = points[rows]
        order = np.argsort(own)
        held = own[order]
        for mask in near_masks():
            at = np.minimum(np.searchsorted(held, own ^ mask), len(held) - 1)
            hit = held[at] == own ^ mask
            forest.add(rows[hit], rows[order[at[hit]]])
        return
    _search(points, inner, forest)
    _search(points, outer, forest)


def links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct points: (point, another point of its group)."""
    forest = Forest(len(points))
    _search(points, np.arange(len(points)), forest)
    label = forest.merge()
    linked = np.nonzero(label != np.arange(len(points)))[0]
    return points[linked], points[label[linked]]


# ------------------------------------------------------------------ Spark


def close_links(points: DataFrame, sample_seed: int = 0) -> DataFrame:
    """Distinct fingerprints ``(fp)`` to edges ``(u, v)`` with the same components as all pairs within RADIUS bits.

    The driver sees a sample of about ``SAMPLE_PER_LEAF`` points a leaf, those whose hash lies below a threshold, so about
    ``SAMPLE_PER_LEAF * MAX_LEAVES`` at most. A shard that is too large even so
    (points too alike to be cut) is searched as pairs of blocks, each in a task of its own.
    """
    n = points.count()
    leaves = min(MAX_LEAVES, max(1, -(-n // SHARD)))
    share = min(1.0, SAMPLE_PER_LEAF * leaves / max(1, n))
    drawn = points.where(F.pmod(F.xxhash64(F.lit(sample_seed), "fp"), F.lit(DRAWS)) < int(share * DRAWS))
    tree = Tree.fit(np.sort(drawn.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)), leaves)
    sent = points.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            rows, leaf = sent.value.shards(fps.view(np.uint64))
            yield pd.DataFrame({"fp": fps[rows], "leaf": leaf})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = links(np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    placed = settle(points.select("fp").mapInPandas(place, "fp bigint, leaf bigint"))
    # one row for each leaf, MAX_LEAVES at most
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(MAX_SHARD)).alias("k"))
    dealt = placed.join(F.broadcast(blocks), "leaf").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("other")
    pairs = dealt.select("fp", "leaf", "own", other).select(
        "fp", "leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )
    return pairs.groupBy("leaf", "a", "b").applyInPandas(search, "u bigint, v bigint")


def roots_of(prints: DataFrame) -> DataFrame:
    """Rows with ``fp`` and ``doc_id`` to one row per fingerprint: ``point``, the ``least`` doc_id that has it, and the ``root`` of its
    component, a fingerprint."""
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(components(close_links(points.select("fp"))))
    named = points.join(roots, F.col("fp") == F.col("node"), "left")
    return settle(named.select(F.col("fp").alias("point"), "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most RADIUS differing bits. A NULL or
    empty text has fingerprint 0 and links like any other. A NULL ``doc_id`` never names a component unless all of
    it is NULL. Repeated rows come back as often as they are there. Other columns are not read.
    """
    prints = settle(with_fingerprint(docs.select("doc_id", "text")))
    named = roots_of(prints)
    names = settle(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = settle(named.join(names, "root").select("point", "component_id"))
    joined = prints.join(by_print, F.col("fp") == F.col("point"), "left")
    return joined.select("doc_id", "fp", "component_id")


def hex_print(column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates, with all their columns: one row of each component.

    It is the row with the smallest ``doc_id`` (NULL last), and of those with one ``doc_id`` the one with the least digest of
    its text (NULL first), so texts that merely share a ``doc_id`` do not displace each other. Rows that are equal in both
    are copies of one document, of which one stays, an arbitrary one if their other columns differ.
    """
    keyed = docs.select("doc_id", "text", F.md5("text").alias("__key"))
    prints = settle(with_fingerprint(keyed, keep=("doc_id", "__key")))
    rooted = prints.join(roots_of(prints), F.col("fp") == F.col("point"))
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__key")).alias("r")
    keep = settle(rooted.groupBy("root").agg(chosen).select(F.col("r.doc_id").alias("__id"), F.col("r.__key").alias("__text")))
    same = lambda key: F.col("doc_id").eqNullSafe(F.col("__id")) & key.eqNullSafe(F.col("__text"))
    kept = docs.join(keep, same(F.md5("text")), "left_semi")
    counts = prints.groupBy("doc_id", "__key").count().where("count > 1")
    repeated = settle(counts.join(keep, same(F.col("__key")), "left_semi").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__text")))
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, same(F.md5("text")), "left_anti")
    several = kept.join(repeated, same(F.md5("text")), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = several.groupBy("doc_id", F.md5("text")).agg(F.first(F.struct(*names)).alias("__row"))
    return single.unionByName(one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
