"""Resampling, MinHash and hard negatives against plain versions on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldpspark.llm import minhash, negatives, resample

from .test_operators import brute_groups, corpus, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ------------------------------------------------------------------ resampling


def plain_features(text, longest):
    words = WORD.findall((text or "").translate(SMALL))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_checksums_of_features(longest):
    texts = ["", "Ab cd, ef", "中文 x" * 50, "a" * 5000 + " b", "x" * 64 + " " + "y" * 63 + "!" + "z" * 128, "\n\n", "one", "ÄÖ É" * 70, "  "]
    texts.append(" ".join(str(k) for k in range(300_000)))
    spec = resample.Resampling(longest=longest, buckets=1 << 20 if longest == 3 else 10_000)
    for text, (n, buckets) in zip(texts, resample.text_buckets(texts, spec)):
        words, features = plain_features(text, longest)
        assert n == words
        assert buckets.tolist() == [zlib.crc32(f.encode()) % spec.buckets for f in features]


def plain_resampling(docs, target, spec):
    s, t = np.zeros(spec.buckets), np.zeros(spec.buckets)
    found = []
    for doc_id, text in docs:
        n, features = plain_features(text, spec.longest)
        found.append((doc_id, text, n, [zlib.crc32(f.encode()) % spec.buckets for f in features]))
    for *_, buckets in found:
        for b in buckets:
            s[b] += 1
    for text in target:
        for f in plain_features(text, spec.longest)[1]:
            t[zlib.crc32(f.encode()) % spec.buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + spec.buckets) / ((a + 1) * (t.sum() + spec.buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text, n, buckets in found:
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"{spec.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, text, n, len(buckets), weight, score))
    able = sorted((r for r in rows if r[2] >= spec.min_words), key=lambda r: (-r[5], r[0] is None, r[0] or 0))
    drawn = able[: spec.percent * len(able) // 100]
    return rows, drawn


def test_resampling_is_the_plain_one(spark):
    docs, rows = corpus(spark)
    target = [rows[0][1], None, "", rows[1][1][:200]]
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    spec = resample.Resampling()
    clashing = docs.withColumns({"rank": F.lit(9), "score": F.lit("x"), "buckets": F.lit(1), "text_key": F.lit(0)})
    got = resample.resample(clashing, aims, spec).collect()
    want, drawn = plain_resampling([(r[0], r[1]) for r in rows], target, spec)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(
        ((r[0], r[2], r[3], r[4], r[5]) for r in want), key=key
    )
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(r[5], r[0]) for r in drawn]
    kept = resample.drawn(clashing, aims, spec)
    assert kept.columns == clashing.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(r[0], r[1]) for r in drawn}


def test_resampling_without_rows(spark):
    docs, _ = corpus(spark)
    none = empty(spark)
    assert resample.resample(none, docs).count() == 0
    assert {r.weight for r in resample.resample(none.unionByName(docs.where("text is null")), none).collect()} == {0}


def test_one_row_repeated_many_times_is_ranked_as_often(spark):
    docs = spark.range(900).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("some words " * 20).alias("text"))
    ranks = [r["rank"] for r in resample.resample(docs, docs).collect()]
    assert sorted(r for r in ranks if r is not None) == list(range(1, 226)) and len(ranks) == 900


# ------------------------------------------------------------------ MinHash


def plain_sets(texts, size=3):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words)} if 0 < len(words) < size else set(zip(*[words[k:] for k in range(size)])))
    return out


def check_components(spark, rows, spec=minhash.MinHash()):
    """``rows`` of distinct document numbers and texts."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, spec).collect()}
    rows = sorted(rows)
    sets = plain_sets([r[1] for r in rows], spec.shingle)
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= spec.percent * len(sets[a] | sets[b])
    groups = brute_groups(rows, near)
    for (doc_id, _), s, root in zip(rows, sets, groups):
        assert (got[doc_id].n_shingles, got[doc_id].component_id, got[doc_id].kept) == (len(s), rows[root][0], rows[root][0] == doc_id)
    return len(set(groups))


def edited(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = "edit" + str(rnd.randrange(10**6))
    return " ".join(words)


def test_minhash_is_the_plain_one(spark):
    rnd = random.Random(3)
    rows = []
    for group in range(8):
        base = prose(rnd, 80 + 10 * group)
        rows += [edited(rnd, base, rnd.randint(0, 6)) for _ in range(12)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one two ", "one two three", "one two three one two three", "Äb cd", "äb cd"]
    rows += ["lone " * 50_000, "LONE " * 50_000, prose(rnd, 30_000)]
    assert check_components(spark, list(enumerate(rows))) > 20


def test_near_misses_of_one_base_meet_each_other(spark, monkeypatch):
    # copies that are no links of the base, and only now and then of each other; several blocks to a bucket
    monkeypatch.setattr(minhash, "SIGNATURES", 16)
    monkeypatch.setattr(minhash, "SETS", 12)
    rnd = random.Random(4)
    base = prose(rnd, 150)
    rows = [edited(rnd, base, 4 + k % 5) for k in range(90)]
    rows += [edited(rnd, r, 1) for r in rows[::9]]
    alone = check_components(spark, list(enumerate(rows)))
    assert 1 < alone < len(rows)


def test_minhash_rows_without_number_and_repeats(spark):
    docs, rows = corpus(spark)
    got = minhash.near_duplicates(docs.withColumns({"point": F.lit(1), "component_id": F.lit(2), "text_key": F.lit(3)})).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None or r.component_id <= r.doc_id for r in got if r.doc_id is not None)
    # the text of the nameless row is that of 2; its component has a name
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(2, False)]
    assert minhash.near_duplicates(empty(spark)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id bigint, text string")
    assert [(r.component_id, r.kept) for r in minhash.near_duplicates(nameless).collect()] == [(None, True)] * 2


def test_words_in_pieces():
    text = "Ab  cÄ\n" * 40 + "x" * 500 + "　y"
    assert [w for p in minhash.word_pieces(text, 16) for w in p] == text.encode().lower().split()
    assert list(minhash.word_pieces("")) == []


# ------------------------------------------------------------------ hard negatives


def plain_negatives(rows, spec=negatives.Mining(), every=10):
    ok = [(i, l, np.floor(np.array(v, float) * spec.scale)) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in ok:
        if i % every:
            continue
        scored = sorted(((-int(v @ w), j, m) for j, m, w in ok if j != i and len(w) == len(v)))
        for p, j, m in [s for s in scored if s[2] == label][: spec.positives]:
            fit = [s for s in scored if s[2] != label and spec.low * -p <= 100 * -s[0] <= spec.high * -p][: spec.negatives]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(fit)]
    return sorted(out)


def vectors(n=400, dim=24, labels=4, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dim)) * spread
    rows = [(k, int(k * 7 % labels), (centre[k * 7 % labels] + rng.normal(size=dim)).tolist()) for k in range(n)]
    return [(k, label, [float(np.float32(x / 6)) for x in v]) for k, label, v in rows]


SCHEMA = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("block", [16_384, 40])
def test_negatives_are_the_plain_ones(spark, block):
    rows = vectors() + vectors(40, dim=5, seed=2)[30:]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    tie = rows[10][2]
    rows += [(k, k % 4, tie) for k in range(500, 560)]
    rows += [(600, None, tie), (610, 1, None), (620, 1, [1.0, None]), (630, 1, [float("nan")] * 24), (None, 1, tie), (640, 2, []), (650, 3, [0.0] * 24), (660, 99, tie), (670, 1, [float("inf")] * 24)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "rank": F.lit("x"), "block": F.lit(0), "dim": F.lit(2)})
    spec = negatives.Mining(rows=block)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0, spec)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, spec)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300


def test_negatives_with_other_windows_repeats_and_nothing(spark):
    rows = vectors(120, dim=70, labels=3, spread=0.2)
    spec = negatives.Mining(positives=2, negatives=7, low=10, high=120, scale=1000, rows=30)
    table = spark.createDataFrame(rows + rows[:50], SCHEMA)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0, spec)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, spec)
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    one = negatives.mine(table.where("label = 1"), F.col("vec_id") % 10 == 0)
    assert one.count() == 0


def test_very_large_components_do_not_end_the_job(spark):
    rows = [(k, k % 2, [1e300 * (1 + k), 1.0]) for k in range(4)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    top = {r.negative_score for r in negatives.mine(table, F.col("vec_id") == 0).collect()}
    assert top <= {2**63 - 1}


def test_index_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(1)
    base = np.floor(256 * rng.normal(size=(500, 64)) / np.arange(1, 65))
    index = negatives.Index(np.arange(500), np.zeros(500, int), base)
    asked = np.floor(256 * rng.normal(size=(20, 64)) / np.arange(1, 65))
    true = asked @ base.T
    for quantile in (0.5, 0.9, 0.999):
        least = np.quantile(true, quantile, axis=1)
        kept, scores = index.reach(asked[:, index.order], least, np.arange(500))
        assert np.array_equal(scores, true[:, kept])
        assert set(np.nonzero((true >= least[:, None]).any(axis=0))[0]) <= set(kept)
    assert len(kept) < 400
