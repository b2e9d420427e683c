"""MinHash near-duplicates: banded signatures, verified candidates, confirmed links, components.

A document is the set of its word shingles; documents with equal sets are one point. A point's signature holds the least
value of many universal hash functions over its set, and each band of it names a bucket. Links are looked for in two rounds,
so that no bucket gives all its pairs:

* every point meets its bucket's leader. Sizes and signatures are compared first, and what remains is confirmed on the
  full sets. Groups of near copies become one component here, with about one pair for each point;
* buckets whose other points still lie in several components are searched in tasks, large ones as pairs of blocks of
  bounded size. Only points with a similar signature in another component go on, and their full sets are intersected by
  matrix products. A task returns a spanning forest of its links.

Two sets of similarity 0.85 share a bucket with a probability of ``1 - (1 - 0.85**7)**32``; it fails for four pairs in a
million. A signature estimate falls short of ``doubt`` for fewer than one in ten million.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldpspark.session import scratch_path, settle

from .graph import components
from .simhash import Forest

# words hashed at once, and shingles that meet all hash functions at once
PIECE = 1 << 22
CHUNK = 2048
# words whose hash a task remembers
REMEMBERED = 1 << 18
# points of a block when signatures, and when sets are compared; shingles of a block of sets
SIGNATURES, SETS, SHINGLES = 2048, 1024, 1 << 21
# columns of a matrix product
COLUMNS = 4096


@dataclass(frozen=True)
class MinHash:
    shingle: int = 3
    # least similarity of a link, in hundredths
    percent: int = 85
    bands: int = 32
    rows: int = 7
    # hundredths that the signatures of a link may agree in at least: five deviations below ``percent``
    doubt: int = 72
    seed: int = 0

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


# ------------------------------------------------------------------ one document

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: str, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, capitals A to Z lower-cased, as lists from about ``size`` bytes each."""
    data = text.encode()
    start = 0
    while start < len(data):
        border = _BLANK.search(data, start + size)
        end = border.start() if border else len(data)
        yield data[start:end].lower().split()
        start = end


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Signer:
    """Sets and signatures of texts."""

    def __init__(self, spec: MinHash):
        rng = np.random.default_rng(spec.seed)
        odd = lambda n, bits: rng.integers(0, 1 << bits, n, np.uint64, endpoint=False) | np.uint64(1)
        self.spec = spec
        self.place = odd(spec.shingle + 1, 63)
        self.factor = odd(spec.hashes, 32).astype(np.uint32)[:, None]
        self.offset = odd(spec.hashes, 32).astype(np.uint32)[:, None]
        self.mix = odd(spec.rows, 63)
        self.known: dict[bytes, int] = {}

    def _words(self, text: str) -> np.ndarray:
        known, parts = self.known, []
        for words in word_pieces(text):
            for word in set(words):
                if word not in known:
                    known[word] = xxhash.xxh64_intdigest(word)
            parts.append(np.fromiter((known[w] for w in words), np.uint64, len(words)))
            if len(known) > REMEMBERED:
                known.clear()
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; of fewer words, one of the whole sequence; of none, empty."""
        words = self._words(text or "")
        size = min(self.spec.shingle, len(words))
        if not size:
            return words
        n = len(words) - size + 1
        mixed = reduce(np.add, (words[k : n + k] * self.place[k] for k in range(size)))
        return np.unique(_finish(mixed + self.place[-1] * np.uint64(size)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.spec.hashes, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(values), CHUNK):
            hashed = self.factor * values[None, start : start + CHUNK]
            hashed += self.offset
            np.minimum(least, hashed.min(axis=1), out=least)
        return least

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        bands = signature.reshape(self.spec.bands, self.spec.rows).astype(np.uint64)
        return _finish((bands * self.mix).sum(axis=1, dtype=np.uint64) + np.arange(self.spec.bands, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, spec: MinHash) -> DataFrame:
    """``doc_id, text_key, n_shingles, point, signature, buckets``; ``point`` is the digest of the set, NULL if it is
    empty, and the signature keeps the last byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(spec)
        for batch in batches:
            sizes, points, signatures, buckets = [], [], [], []
            for text in batch.column("text"):
                found = signer.shingles(text.as_py())
                sizes.append(len(found))
                if not len(found):
                    points.append(None), signatures.append(None), buckets.append([])
                    continue
                signature = signer.signature(found)
                points.append(hashlib.md5(found.tobytes()).digest())
                signatures.append((signature & 255).astype(np.uint8).tobytes())
                buckets.append(signer.buckets(signature))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(points, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "point", "signature", "buckets"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = f"doc_id {kind}, text_key string, n_shingles bigint, point binary, signature binary, buckets array<bigint>"
    return docs.select("doc_id", "text", F.md5("text").alias("text_key")).mapInArrow(run, types)


def sets_of(docs: DataFrame, points: DataFrame, spec: MinHash) -> DataFrame:
    """``of, shingles``: the full sets of some points ``(point, doc_id, text_key)``, from the text that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(spec)
        for batch in batches:
            sets = [signer.shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(sets, pa.list_(pa.int64()))], ["of", "shingles"])

    named = points.select(F.col("point").alias("of"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    texts = docs.select("doc_id", "text").withColumn("text_key", F.md5("text"))
    same = (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    found = texts.join(named, same).select("of", "text").mapInArrow(run, "of binary, shingles array<bigint>")
    # a row that is there several times stands for its point once
    return found.dropDuplicates(["of"])


# ------------------------------------------------------------------ candidates and links


def size_fits(a: Column, b: Column, spec: MinHash) -> Column:
    """Necessary for a link: no intersection is larger than the smaller set."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * spec.percent


def alike(pairs: DataFrame, points: DataFrame, spec: MinHash) -> DataFrame:
    """Pairs ``(u, v)`` whose signatures agree in ``doubt`` hundredths or more."""
    hashes, least = spec.hashes, spec.doubt * spec.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, hashes) for n in (2, 3))
            kept = pa.array((a == b).sum(axis=1) * 100 >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["u", "v"])

    side = lambda name: points.select(F.col("point").alias(name), F.col("signature").alias(f"s_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", "s_u", "s_v").mapInArrow(run, "u binary, v binary")


def confirmed(pairs: DataFrame, sets: DataFrame, spec: MinHash) -> DataFrame:
    """Pairs ``(u, v)`` that are links by their full sets."""
    side = lambda name: sets.select(F.col("of").alias(name), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("s_u", "s_v"))
    counted = both.select("u", "v", common.alias("common"), (F.size("s_u") + F.size("s_v") - common).alias("union"))
    return counted.where(F.col("common") * 100 >= F.col("union") * spec.percent).select("u", "v")


def in_blocks(members: DataFrame, parts: Column) -> DataFrame:
    """Members ``(bucket, point, ..)`` of buckets in ``parts`` blocks, with each pair of blocks ``(a, b)`` they belong to."""
    own = members.withColumn("k", F.greatest(parts, F.lit(1)).cast("bigint")).withColumn("own", F.pmod(F.xxhash64("point"), F.col("k")))
    others = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    return others.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("k", "own", "other")


def with_partner(group: pd.DataFrame, spec: MinHash) -> np.ndarray:
    """Rows with a row of another component, of fitting size and a similar signature."""
    signature = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
    size = group["n_shingles"].to_numpy()
    component = group["component"].factorize()[0]
    found = np.zeros(len(group), bool)
    tile = max(1, (1 << 24) // signature.size)
    for start in range(0, len(group), tile):
        end = start + tile
        fits = component[start:end, None] != component[None, :]
        a, b = size[start:end, None], size[None, :]
        fits &= np.minimum(a, b) * 100 >= np.maximum(a, b) * spec.percent
        fits &= np.count_nonzero(signature[start:end, None, :] == signature[None, :, :], axis=2) * 100 >= spec.doubt * signature.shape[1]
        found[start:end] |= fits.any(axis=1)
        found |= fits.any(axis=0)
    return found


def set_links(sets: list[np.ndarray], component: np.ndarray, spec: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of different components, by exact intersections of all rows."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    shingle, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one set is in no intersection
    number = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[column]
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(number, [start, start + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[lo:hi], number[lo:hi] - start] = 1
        common += block @ block.T
    linked = 100 * common >= spec.percent * (size[:, None] + size[None, :] - common)
    i, j = np.nonzero(np.triu(linked & (component[:, None] != component[None, :]), 1))
    forest = Forest(len(sets))
    forest.add(i, j)
    label = forest.merge()
    moved = np.nonzero(label != np.arange(len(sets)))[0]
    return moved, label[moved]


# ------------------------------------------------------------------ the whole


def near_links(docs: DataFrame, points: DataFrame, spec: MinHash) -> DataFrame:
    """Edges ``(u, v)`` between points with the same components as all links."""
    held = points.select(F.explode("buckets").alias("bucket"), "point", "n_shingles")
    leaders = held.groupBy("bucket").agg(F.min(F.struct("point", "n_shingles")).alias("leader"), F.count(F.lit(1)).alias("n"))
    shared = settle(leaders.where("n > 1").select(F.col("bucket").alias("__bucket"), "leader", "n"))
    members = held.join(shared, F.col("bucket") == F.col("__bucket")).where(F.col("point") != F.col("leader.point"))
    members = settle(members.select("bucket", "point", "n_shingles", "leader"))

    first = members.where(size_fits(F.col("n_shingles"), F.col("leader.n_shingles"), spec))
    first = first.select(F.col("leader.point").alias("u"), F.col("point").alias("v")).distinct()
    first = settle(alike(first, points, spec))
    ends = first.select(F.explode(F.array("u", "v")).alias("of")).distinct()
    sets = settle(sets_of(docs, points.join(ends, F.col("point") == F.col("of"), "left_semi"), spec))
    links = settle(confirmed(first, sets, spec))

    roots = settle(components(links))
    labelled = members.select("bucket", "point", "n_shingles").join(roots, F.col("point") == F.col("node"), "left")
    labelled = settle(labelled.select("bucket", "point", "n_shingles", F.coalesce("root", "point").alias("component")))
    # the leader has met all; the others have met each other where they are of one component
    mixed = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = settle(mixed.where(F.col("lo") != F.col("hi")).select(F.col("bucket").alias("__bucket"), "n"))
    open_ = labelled.join(mixed, F.col("bucket") == F.col("__bucket")).drop("__bucket")
    signatures = points.select(F.col("point").alias("__point"), "signature")
    open_ = settle(open_.join(signatures, F.col("point") == F.col("__point")).drop("__point"))

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        return group.loc[with_partner(group, spec), ["bucket", "point", "n_shingles", "component"]]

    dealt = in_blocks(open_, F.ceil(F.col("n") / SIGNATURES))
    going = dealt.groupBy("bucket", "a", "b").applyInPandas(screen, "bucket bigint, point binary, n_shingles bigint, component binary")
    going = settle(going.distinct())

    ends = going.select(F.col("point").alias("of")).distinct()
    missing = ends.join(sets.select("of"), "of", "left_anti")
    more = settle(sets_of(docs, points.join(missing, F.col("point") == F.col("of"), "left_semi"), spec))
    loads = going.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load"))
    loads = settle(loads.select(F.col("bucket").alias("__bucket"), F.greatest(F.ceil(F.col("n") / SETS), F.ceil(F.col("load") / SHINGLES)).alias("parts")))
    full = going.join(loads, F.col("bucket") == F.col("__bucket")).drop("__bucket")
    full = settle(full.join(sets.unionByName(more), F.col("point") == F.col("of")).drop("of"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        u, v = set_links(list(group["shingles"]), group["component"].factorize()[0], spec)
        point = group["point"].to_numpy()
        return pd.DataFrame({"u": point[u], "v": point[v]})

    second = in_blocks(full, F.col("parts")).groupBy("bucket", "a", "b").applyInPandas(search, "u binary, v binary")
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second)


def near_duplicates(docs: DataFrame, spec: MinHash = MinHash()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of ``percent`` hundredths or more, ``kept`` whether it is the
    document's own. A text without words, or NULL, has an empty set and stands alone. A NULL ``doc_id`` never names a
    component that has another one; alone it has no ``component_id`` and is kept. Repeated rows come back as often as they
    are there. Other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "signatures")
    signed(docs, spec).write.parquet(path)
    every = spark.read.parquet(path)
    points = every.where("point is not null").groupBy("point").agg(
        F.min("doc_id").alias("least"),
        F.min(F.struct("doc_id", "text_key")).alias("first"),
        *[F.first(c).alias(c) for c in ("n_shingles", "signature", "buckets")],
    )
    path = scratch_path(spark, "points")
    points.select("point", "least", "first.doc_id", "first.text_key", "n_shingles", "signature", "buckets").write.parquet(path)
    points = spark.read.parquet(path)
    roots = settle(components(near_links(docs, points, spec)))
    named = points.select("point", "least").join(roots, F.col("point") == F.col("node"), "left")
    named = settle(named.select("point", "least", F.coalesce("root", "point").alias("root")))
    names = settle(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_point = settle(named.join(names, "root").select(F.col("point").alias("of"), "component_id"))
    found = every.select("doc_id", "n_shingles", "point").join(by_point, F.col("point") == F.col("of"), "left")
    component = F.when(F.col("point").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
