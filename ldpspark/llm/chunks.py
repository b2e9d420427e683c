"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over the bytes of each text. Places where the text may be cut are the ends of words (and, in
text without blanks, places that the hash picks about as often); it is cut where the hash is lowest among its neighbours.
Cuts depend only on nearby bytes, so an insertion moves chunks but does not change them. Chunks with equal digests are the same passage:
the first occurrence (by ``doc_id``, then place) stays, runs of later ones that are long enough are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ldpspark.session import scratch_path, settle

from .linededup import place
from .portions import portions

# bytes the rolling hash looks back (a power of two)
REACH = 16
# cutting places to each side that must have a higher hash
NEIGHBOURS = 4
# one byte in so many is a cutting place inside a word, on average
RARE = 256
# from so many bytes after a blank on, a text counts as unspaced: there the hash picks one in so many places between ASCII
# characters, and one in so many before a longer character, so that places are about as dense as the ends of words
UNSPACED = 48
PICK_ASCII, PICK_WIDE = 6, 2
# a run of repeated chunks counts from so many words on, or from so many bytes for each of these words
MIN_WORDS = 20
WORD_BYTES = 12
GEAR = np.random.default_rng(2024).integers(1, 1 << 32, 256, dtype=np.uint32)
GEAR[0] = 0
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """Sum of gear values of the last REACH bytes, each shifted by its distance, modulo 2**32."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def unspaced(data: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Places at least UNSPACED bytes after the last blank or start of a text, without the last byte before the next."""
    edges = np.nonzero(blank | (data == 0))[0]
    long = np.nonzero(np.diff(edges) > UNSPACED + 1)[0]
    return np.concatenate([np.empty(0, np.int64), *[np.arange(a + UNSPACED, b - 1) for a, b in zip(edges[long], edges[long + 1])]])


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Chunks of all texts: text number, start and end in the joined data, words before each, offset of the text.

    The data are the texts with REACH zero bytes before each, so that no hash sees another text."""
    gap = b"\0" * REACH
    joined = gap + gap.join(texts) + gap
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = REACH + np.concatenate([[0], np.cumsum(sizes + REACH)[:-1]])
    ends = starts + sizes
    h = rolling(data)
    blank = BLANKS[data]
    blank_next = np.append(blank[1:], True)
    inside = np.append((data[1:] & 0xC0) != 0x80, False)
    candidate = (blank & ~blank_next) | (~blank & ~blank_next & inside & (h % RARE == RARE - 1) & (data != 0))
    at = np.nonzero(candidate)[0]
    more = unspaced(data, blank)
    if len(more):
        wide = data[more + 1] >= 0xC0
        # the upper bits, which all REACH bytes have a part in
        picked = (h[more] >> 16) % np.where(wide, PICK_WIDE, PICK_ASCII).astype(np.uint32) == 0
        at = np.union1d(at, more[picked & inside[more] & ~blank_next[more]])
    owner = np.searchsorted(starts, at, side="right") - 1
    valid = at < ends[owner] - 1
    at, owner = at[valid], owner[valid]
    # hashes with NEIGHBOURS highest values between texts
    spot = np.arange(len(at)) + NEIGHBOURS * (owner + 1)
    row = np.full(len(at) + NEIGHBOURS * (len(texts) + 1), 0xFFFFFFFF, np.uint32)
    row[spot] = h[at]
    lowest = np.ones(len(at), bool)
    for k in range(1, NEIGHBOURS + 1):
        lowest &= (row[spot] < row[spot - k]) & (row[spot] <= row[spot + k])
    at, owner = at[lowest] + 1, owner[lowest]
    filled = np.nonzero(sizes)[0]
    begin = np.concatenate([starts[filled], at])
    of = np.concatenate([filled, owner])
    order = np.argsort(begin, kind="stable")
    begin, of = begin[order], of[order]
    stop = np.append(begin[1:], 0)
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.empty(0, bool)
    stop = stop[: len(begin)]
    stop[last] = ends[of[last]]
    blank_before = np.append(True, (blank | (data == 0))[:-1])
    words = np.concatenate([[0], np.cumsum(~blank & (data != 0) & blank_before)])
    return of, begin, stop, words, starts, joined


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, at, start, stop, word_start, word_stop, high, low``: number, byte range, words before its
    ends and 128-bit digest of every chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "text_key", "at", "start", "stop", "word_start", "word_stop", "high", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in portions(batch.column(2)):
                data = [t.encode() for t in texts]
                of, begin, stop, words, starts, joined = cut(data)
                view = memoryview(joined)
                digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begin.tolist(), stop.tolist())])
                high, low = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T
                first = np.concatenate([[0], np.nonzero(of[1:] != of[:-1])[0] + 1]) if len(of) else np.empty(0, np.int64)
                counts = np.diff(np.append(first, len(of)))
                number = np.arange(len(of)) - np.repeat(first, counts)
                base = words[starts[of]]
                rows = pa.array(of + done)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        *[
                            pa.array(x.astype(np.int32))
                            for x in (number, begin - starts[of], stop - starts[of], words[begin] - base, words[stop] - base)
                        ],
                        pa.array(high),
                        pa.array(low),
                    ],
                    names,
                )
                done += len(texts)

    fields = f"doc_id {kind}, text_key bigint, at int, start int, stop int, word_start int, word_stop int, high bigint, low bigint"
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, fields)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_key, start, stop, n_words, kept_doc_id``: byte ranges of later occurrences, one row each.

    ``doc_id`` is an integer. ``kept_doc_id`` is the document with the first occurrence of the range's first chunk. Runs
    of fewer than ``min_words`` words are left alone, unless they have WORD_BYTES bytes for each of these words: text
    without blanks has hardly any words. NULL and empty texts have no chunks. A NULL ``doc_id`` comes before
    all others. Rows with the same ``doc_id`` count as one document, and rows with the same text too give their ranges
    once. Other columns are not read.
    """
    # cut once: both the counts and the later occurrences are read from here
    path = scratch_path(docs.sparkSession, "chunks")
    chunk_rows(docs).write.parquet(path)
    chunks = docs.sparkSession.read.parquet(path).withColumn("place", place().cast("decimal(38,0)"))
    first = chunks.groupBy("high", "low").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.min_by("doc_id", "place").alias("kept_doc_id")
    )
    first = settle(first.where("n > 1").select(F.col("high").alias("__high"), F.col("low").alias("__low"), "first", "kept_doc_id"))
    same = (F.col("high") == F.col("__high")) & (F.col("low") == F.col("__low"))
    later = chunks.join(first, same).where(F.col("place") > F.col("first"))
    by_text = Window.partitionBy("doc_id", "text_key").orderBy("at")
    runs = later.withColumn("run", F.col("at") - F.dense_rank().over(by_text))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.max("word_stop") - F.min("word_start")).cast("bigint").alias("n_words"),
        F.min_by("kept_doc_id", "at").alias("kept_doc_id"),
    )
    enough = (F.col("n_words") >= min_words) | (F.col("stop") - F.col("start") >= WORD_BYTES * min_words)
    return spans.where(enough).select("doc_id", "text_key", "start", "stop", "n_words", "kept_doc_id")


def dedup_text(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated ranges cut out of ``text``; all rows and columns stay."""
    spans = repeated_spans(docs.select("doc_id", "text"), min_words)
    cuts = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    cuts = settle(cuts.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "__cuts"))
    names = docs.columns
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    joined = keyed.join(cuts, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__key")), "left")
    joined = joined.withColumn("__data", F.encode("text", "UTF-8"))
    begins = F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda c: c["stop"]))
    ends = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.octet_length("text")))
    parts = F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(F.col("__data"), a + 1, b - a), "UTF-8"))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names])
