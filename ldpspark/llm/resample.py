"""Importance resampling towards a target distribution, with hashed word features.

Features are runs of one to ``longest`` words. A feature's bucket is the CRC-32 of its bytes, modulo a bucket count. CRC-32
without its start value is linear: the checksum of a span is the XOR of one table entry per byte, chosen by the byte and
its distance from the end of the span, and a constant for the length. So all spans of many texts are summed in one
``bitwise_xor.reduceat``. Spans longer than the table are cut into blocks, whose sums are folded from front to back.

Texts are read once: their buckets are written beside the document number, two bytes a feature, and both the counts over
the corpus and the weights are taken from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldpspark.operators.ordered import prefix_sums
from ldpspark.session import scratch_path, settle

from .portions import portions

# the reversed polynomial of CRC-32 (fixed value)
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
# distances from the end of a span that the table holds; longer spans are folded in blocks of this many bytes
REACH = 64
# span bytes looked up at once
BLOCK = 1 << 20


@dataclass(frozen=True)
class Resampling:
    longest: int = 2
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: int = 7


# ------------------------------------------------------------------ checksums of spans


def _after_zero(state: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (state >> np.uint32(8)) ^ first[state & np.uint32(255)]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``place[distance, byte]``; the state after 0.. zero bytes from the start value; the effect of a block of zero bytes
    on each byte of a state, ``skip[byte number, byte]``."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), first >> np.uint32(1))
    place = np.empty((REACH, 256), np.uint32)
    place[0] = first
    for distance in range(1, REACH):
        place[distance] = _after_zero(place[distance - 1], first)
    start = np.full(REACH + 1, ONES)
    for length in range(1, REACH + 1):
        start[length] = _after_zero(start[length - 1 : length], first)[0]
    skip = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(REACH):
        skip = _after_zero(skip, first)
    return place, start, skip


PLACE, START, SKIP = _tables()


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans ``data[start:end]``, none empty. Spans may overlap."""
    out = np.empty(len(starts), np.uint32)
    reached = np.cumsum(ends - starts)
    lo = 0
    while lo < len(starts):
        done = reached[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(reached, done + BLOCK, "right")))
        out[lo:hi] = _crc_some(data, starts[lo:hi], ends[lo:hi])
        lo = hi
    return out


def _crc_some(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    more = (length - 1) // REACH
    head = length - more * REACH
    state = START[head] ^ _xor(data, starts, starts + head)
    left = np.nonzero(more)[0]
    at = starts + head
    while len(left):
        # one block further in all spans that are not at their end
        old = state[left]
        moved = SKIP[0, old & 255] ^ SKIP[1, (old >> 8) & 255] ^ SKIP[2, (old >> 16) & 255] ^ SKIP[3, old >> 24]
        state[left] = moved ^ _xor(data, at[left], at[left] + REACH)
        at[left] += REACH
        left = left[at[left] < ends[left]]
    return state ^ ONES


def _xor(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the table entries of each span; spans of 1 to REACH bytes."""
    length = ends - starts
    edge = np.cumsum(length)
    first = edge - length
    distance = np.repeat(edge - 1, length) - np.arange(edge[-1])
    byte = data[np.repeat(ends - 1, length) - distance]
    return np.bitwise_xor.reduceat(PLACE.ravel()[distance * 256 + byte], first)


# ------------------------------------------------------------------ features of texts

# digits, small letters and all bytes of characters beyond ASCII make words; capitals are lower-cased first
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True


def text_buckets(texts: list[str], spec: Resampling) -> Iterator[tuple[int, np.ndarray]]:
    """``(number of words, buckets of all features)`` of each text."""
    encoded = [t.encode() + b"\n" for t in texts]
    data = _LOWER[np.frombuffer(b"".join(encoded), np.uint8)]
    word = _WORD[data]
    # every word, followed by one space: each text ends in a separator, so each word has one behind it
    behind = ~word
    behind[1:] &= word[:-1]
    behind[0] = False
    held = word | behind
    borders = np.cumsum([len(e) for e in encoded])
    upto = np.searchsorted(np.nonzero(behind)[0], borders, "left")
    data = np.where(word, data, np.uint8(32))[held]
    ends = np.nonzero(data == 32)[0]
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    kind = np.uint16 if spec.buckets <= 1 << 16 else np.uint32
    runs = []
    for size in range(1, spec.longest + 1):
        n = max(0, len(ends) - size + 1)
        crc = crc_spans(data, starts[:n], ends[size - 1 :]) if n else np.empty(0, np.uint32)
        runs.append((crc % np.uint32(spec.buckets)).astype(kind))
    before = 0
    for border in upto:
        # a run that begins in this text and ends in the next one is none
        yield border - before, np.concatenate([r[before : max(before, border - k)] for k, r in enumerate(runs)])
        before = border


def features(docs: DataFrame, spec: Resampling = Resampling()) -> DataFrame:
    """``doc_id, text_key, n_words, n_features, buckets``: the buckets of all features of ``text`` as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in portions(batch.column("text")):
                found = list(text_buckets(texts, spec))
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([int(n) for n, _ in found], pa.int64()),
                        pa.array([len(b) for _, b in found], pa.int64()),
                        pa.array([b.tobytes() for _, b in found], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_words", "n_features", "buckets"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.md5("text").alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key string, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(found: DataFrame, spec: Resampling = Resampling()) -> DataFrame:
    """``bucket, n``: features in each bucket; a task hands on one row per bucket at most."""
    kind = np.uint16 if spec.buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(spec.buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                sums += np.bincount(np.frombuffer(cell.as_buffer(), kind), minlength=spec.buckets)
        some = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    partial = found.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, spec: Resampling = Resampling()) -> np.ndarray:
    """Thousandths of a nat that a feature of each bucket speaks for the target, from the two tables of counts.

    One number per bucket: the table on the driver depends on ``buckets`` alone.
    """
    every = corpus.sparkSession.range(spec.buckets).withColumnRenamed("id", "bucket")
    s = corpus.select("bucket", F.col("n").alias("s"))
    t = target.select("bucket", F.col("n").alias("t"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    rows = both.toPandas().sort_values("bucket")
    own, other = rows["s"].to_numpy(float), rows["t"].to_numpy(float)
    ratio = (other + 1) * (own.sum() + spec.buckets) / ((own + 1) * (other.sum() + spec.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


# ------------------------------------------------------------------ weights and the draw


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel draw that belongs to the document number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighted(found: DataFrame, gain: np.ndarray, spec: Resampling = Resampling()) -> DataFrame:
    """Adds ``weight``, the floored mean gain of a document's features (0 without any), and drops the buckets."""
    kind = np.uint16 if spec.buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(c.as_buffer(), kind) for c in batch.column("buckets")]
            means = [int(gain[c].sum()) // len(c) if len(c) else 0 for c in cells]
            kept = [batch.column(c) for c in ("doc_id", "text_key", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(means, pa.int64())], ["doc_id", "text_key", "n_words", "n_features", "weight"])

    id_kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {id_kind}, text_key string, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, spec: Resampling = Resampling()) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_features, weight, score, rank``.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``. Of the N documents with ``min_words`` words or more,
    the ``percent`` N / 100 (rounded down) of the highest ``score`` get their ``rank`` from 1; the others have NULL. Ties go
    to the smaller ``doc_id``, then to fewer features and the lesser ``text_key``; a NULL ``doc_id`` comes last, and draws as
    an empty one. Rows repeated in all of these are interchangeable and each counts. A NULL text is an empty one: no
    words, weight 0. Empty tables give no rows, an empty target no features. Other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "features")
    features(docs, spec).write.parquet(path)
    found = spark.read.parquet(path)
    aims = features(target.select(F.lit(0).alias("doc_id"), "text"), spec)
    gain = gains(bucket_counts(found, spec), bucket_counts(aims, spec), spec)
    scored = weighted(found, gain, spec).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), spec.seed))
    scored = settle(scored)
    able = scored.where(F.col("n_words") >= spec.min_words)
    # equal rows are ranked as one, so that no number of repeats ends up in one slice
    every = ["doc_id", "text_key", "n_words", "n_features", "weight", "score"]
    once = able.groupBy(*every).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("text_key")]
    placed = prefix_sums(once, [], order, {"copies": "n"})
    drawn = F.floor(F.col("n_all") * spec.percent / 100)
    ranked = placed.select(*every, drawn.alias("drawn"), F.explode(F.sequence(F.col("n_before") + 1, F.col("n_before") + F.col("copies"))).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).drop("drawn")
    return ranked.unionByName(scored.where(F.col("n_words") < spec.min_words).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, spec: Resampling = Resampling()) -> DataFrame:
    """The documents drawn, with all their columns. Documents that are equal in ``doc_id`` and text are drawn together as
    soon as one of them is."""
    kept = resample(docs, target, spec).where(F.col("rank").isNotNull())
    kept = settle(kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.md5("text").eqNullSafe(F.col("__key"))
    return docs.join(kept, same, "left_semi")
