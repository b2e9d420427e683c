"""Quality rules: word statistics and the fertility of a public tokenizer.

How a fixed vocabulary cuts a text tells much about it: natural prose gives long tokens of many kinds, while shouting,
tables, symbol noise and loops give short, byte-level or few kinds of tokens. Each document gets characters per token,
the share of byte-fallback tokens and the entropy of its tokens; a document outside the bands of its language (or, for
other languages, of its script) is rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .portions import portions

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
# cut words a worker remembers before it starts afresh
MEMORY = 200_000
# longest word cut in one piece by the tokenizer's own call; longer ones are cut at this many characters
LONG_WORD = 4096


@dataclass(frozen=True)
class Band:
    """A document passes with all of: characters per token in [low, high], byte share at most ``bytes``, entropy (bits
    per token) at least ``entropy``. Entropy is only asked of documents with ``tokens`` tokens or more."""

    low: float
    high: float
    bytes: float = 0.05
    entropy: float = 5.5
    tokens: int = 100


# Bands by language, then by script.
BANDS: Mapping[str, Band] = {
    "en": Band(2.05, 7.0),
    "de": Band(2.07, 7.0),
    "fr": Band(1.8, 7.0),
    "es": Band(1.8, 7.0),
    "latin": Band(1.5, 8.0, entropy=4.5),
    "cyrillic": Band(1.2, 8.0, entropy=4.5),
    "greek": Band(0.8, 8.0, bytes=0.3, entropy=4.0),
    "arabic": Band(0.6, 8.0, bytes=0.3, entropy=4.0),
    "hebrew": Band(0.6, 8.0, bytes=0.3, entropy=4.0),
    "devanagari": Band(0.4, 8.0, bytes=0.6, entropy=4.0),
    "cjk": Band(0.3, 4.0, bytes=0.6, entropy=4.0),
    "hangul": Band(0.3, 4.0, bytes=0.7, entropy=4.0),
    "other": Band(0.2, 10.0, bytes=0.9, entropy=4.0),
}

# Unicode ranges of the scripts named above.
SCRIPTS = (
    ("latin", r"[A-Za-z\x{C0}-\x{24F}]"),
    ("cyrillic", r"[\x{400}-\x{52F}]"),
    ("greek", r"[\x{370}-\x{3FF}]"),
    ("arabic", r"[\x{600}-\x{6FF}]"),
    ("hebrew", r"[\x{590}-\x{5FF}]"),
    ("devanagari", r"[\x{900}-\x{97F}]"),
    ("cjk", r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"),
    ("hangul", r"[\x{AC00}-\x{D7AF}]"),
)

COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_tokens bigint, chars_per_token double, byte_share double, token_entropy double"
)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """One per Python worker, with a mask of the ids that stand for single bytes or nothing known."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])


class Cutter:
    """Tokens of words, remembered between documents. Only words count; how a text is spaced and broken into lines has
    no influence on the measures."""

    def __init__(self, path: str):
        self.sp, self.fallback = tokenizer(path)
        self.known: dict[bytes, list[int]] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        words = set().union(*texts)
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        texts = [w.decode() for w in new]
        short = [t if len(t) <= LONG_WORD else "" for t in texts]
        for word, text, ids in zip(new, texts, self.sp.encode(short, num_threads=1)):
            if len(text) > LONG_WORD:
                parts = [text[k : k + LONG_WORD] for k in range(0, len(text), LONG_WORD)]
                ids = list(chain.from_iterable(self.sp.encode(parts, num_threads=1)))
            self.known[word] = ids


def word_statistics(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.encode().split()]
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered, end = 0, 0
    if len(counts) < len(windows):
        for k, window in enumerate(windows):
            if counts[window] > 1:
                covered += k + 3 - max(k, end)
                end = k + 3
    return (
        len(words),
        sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        covered,
    )


def fertility(words: list[bytes], cutter: Cutter, word_chars: int) -> tuple[int, float | None, float | None, float | None]:
    """n_tokens, characters per token, byte share, entropy in bits; NULL where there is no token."""
    ids = np.fromiter(chain.from_iterable(map(cutter.known.__getitem__, words)), np.int32)
    if not len(ids):
        return 0, None, None, None
    counts = np.unique(ids, return_counts=True)[1]
    entropy = math.log2(len(ids)) - float(counts @ np.log2(counts)) / len(ids)
    return len(ids), word_chars / len(ids), float(cutter.fallback[ids].mean()), max(0.0, entropy)


def with_statistics(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, lang, script`` and the COLUMNS above, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(path)
        for batch in batches:
            rows = []
            for texts in portions(batch.column(3)):
                split = [text.encode().split() for text in texts]
                cutter.learn(split)
                for text, words in zip(texts, split):
                    base = word_statistics(text, words)
                    rows.append((*base, *fertility(words, cutter, base[1])))
            found = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, k) for c, k in zip(found, kinds)]],
                ["doc_id", "lang", "script", *[c.split()[0] for c in COLUMNS.split(", ")]],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), script("text").alias("script"), "text")
    return seen.mapInArrow(run, f"doc_id {kind}, lang string, script string, {COLUMNS}")


def script(text: str) -> Column:
    """The script of most letters of the whole text, of equal counts the first in SCRIPTS; ``other`` without any letter.
    Letters are counted only where there are others than those of the first script."""
    (first, own), *others = SCRIPTS
    letters = [F.length(F.regexp_replace(text, f"[^{pattern[1:-1]}]+", "")) for _, pattern in SCRIPTS]
    most = F.greatest(*letters)
    named = F.lit(first)
    for (name, _), n in reversed(list(zip(SCRIPTS, letters))):
        named = F.when(n == most, name).otherwise(named)
    foreign = F.regexp_like(text, F.lit("[" + "".join(pattern[1:-1] for _, pattern in others) + "]"))
    return F.when(foreign, named).when(F.regexp_like(text, F.lit(own)), first).otherwise("other")


def judge(bands: Mapping[str, Band] = BANDS) -> Column:
    """Inside the bands of the document's language or script? A document without tokens is not."""
    verdict = F.lit(False)
    place = F.when(F.col("lang").isin(list(bands)), F.col("lang")).otherwise(F.col("script"))
    for name, band in bands.items():
        inside = (
            F.col("chars_per_token").between(band.low, band.high)
            & (F.col("byte_share") <= band.bytes)
            & ((F.col("n_tokens") < band.tokens) | (F.col("token_entropy") >= band.entropy))
        )
        verdict = F.when(place == name, inside).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def quality(docs: DataFrame, path: str | None = None, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """One row per document: ``doc_id``, the word statistics, ``base_failed``, ``kept`` and the fertility measures.

    A NULL or empty text has no words, fails the base rules and is not kept. ``lang`` NULL or unknown falls back to
    the script of the text. Repeated rows are judged each. Only ``doc_id``, ``lang`` and ``text`` are read; other
    columns, whatever their names, have no influence.
    """
    seen = with_statistics(docs, path or public_tokenizers.path(VOCABULARY))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = seen.withColumn("base_failed", base).withColumn("kept", ~base & judge(bands))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return judged.select("doc_id", *names[:5], "base_failed", "kept", *names[5:], "lang", "script")


def keep_good(docs: DataFrame, path: str | None = None, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The documents that pass, with all their columns. The text is judged in place, so no join and no shuffle."""
    place = path or public_tokenizers.path(VOCABULARY)
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), "lang", "text"
    )
    judged = quality(packed, place, bands).where("kept").select(F.col("doc_id").alias("__row"))
    return judged.select(*[F.col("__row").getField(c).alias(c) for c in names])
