"""Byte-level BPE with sentencepiece.

A rank vocabulary of byte strings becomes a sentencepiece BPE model: each byte is mapped to a printable character, a
piece's score is its negative rank (lowest rank merges first, leftmost on ties), and normalisation is the identity.
Text is cut into pre-tokens by the public pattern; a pre-token that is itself in the vocabulary is one token, any other
is merged by sentencepiece. Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .portions import portions

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# pre-tokens a worker remembers before it starts afresh
MEMORY = 150_000
# texts are cut into pre-tokens this many at a time, so that one very long text needs no list of all its pre-tokens
PART = 1 << 20
# The letters, digits and blanks below U+0250. Within them the standard library's faster matcher cuts by
# explicit classes as the public pattern does.
NARROW = re.compile("[\x00-\u024f]*")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = "\t-\r \x85\xa0"
# a piece outside the byte alphabet, for the unknown token that sentencepiece asks for
UNKNOWN = "⁇"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b if b in plain else next(spare)) for b in range(256))


# ------------------------------------------------------------------ the model file


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def model(vocabulary: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece model. Piece numbers are positions in rank order; the unknown piece
    comes last. Fields of the public model format: pieces 1 (piece 1, score 2, type 3), trainer 2 (type 3, size 4,
    unknown, begin, end, pad ids 40 to 43), normaliser 3 (name 1, dummy prefix 3, extra blanks 4, escape 5)."""
    letters = byte_alphabet()
    out = []
    for token, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
        piece = "".join(letters[b] for b in token).encode()
        out.append(_bytes(1, _bytes(1, piece) + _float(2, -float(rank)) + _int(3, 1)))
    out.append(_bytes(1, _bytes(1, UNKNOWN.encode()) + _float(2, 0.0) + _int(3, 2)))
    size = len(out)
    out.append(_bytes(2, _int(3, 2) + _int(4, size) + _int(40, size - 1) + _int(41, -1) + _int(42, -1) + _int(43, -1)))
    out.append(_bytes(3, _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)))
    return b"".join(out)


# ------------------------------------------------------------------ encoding


class Encoder:
    """Token ids of texts; lives in one Python worker."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model(self.ranks))
        self.ids = [rank for _, rank in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.plain = self.ids == list(range(len(self.ids)))
        self.alphabet = byte_alphabet()
        self.pattern = self.narrow = regex.compile(pattern)
        if pattern == public_tokenizers.PATTERN:
            classes = (
                (r"[^\s\p{L}\p{N}]", f"[^{BLANK}{LETTER}{NUMBER}]"),
                (r"\p{L}", f"[{LETTER}]"),
                (r"\p{N}", f"[{NUMBER}]"),
                (r"\s", f"[{BLANK}]"),
                (r"\S", f"[^{BLANK}]"),
            )
            for general, explicit in classes:
                pattern = pattern.replace(general, explicit)
            self.narrow = re.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        merged, mapped = [], []
        for text in set().union(*texts):
            if text not in self.known:
                data = text.encode()
                whole = self.ranks.get(data)
                if whole is not None:
                    self.known[text] = (whole,)
                else:
                    merged.append(text)
                    mapped.append(data.decode("latin-1").translate(self.alphabet))
        for text, pieces in zip(merged, self.sp.encode(mapped, num_threads=1) if mapped else ()):
            self.known[text] = tuple(pieces if self.plain else [self.ids[p] for p in pieces])

    def encode(self, texts: list[str]) -> list[array]:
        """32-bit ids of each text; a text above PART characters is taken by itself, in parts."""
        out = []
        if len(texts) == 1 and len(texts[0]) > PART:
            ids = array("i")
            for part in self._parts(texts[0]):
                self.learn([part])
                ids.extend(chain.from_iterable(map(self.known.__getitem__, part)))
            return [ids]
        cut = [(self.narrow if NARROW.fullmatch(t) else self.pattern).findall(t) for t in texts]
        self.learn(cut)
        for pretokens in cut:
            out.append(array("i", chain.from_iterable(map(self.known.__getitem__, pretokens))))
        return out

    def _parts(self, text: str) -> Iterator[list[str]]:
        matches = map(regex.Match.group, self.pattern.finditer(text))
        while part := list(islice(matches, PART)):
            yield part


class Decoder:
    """Bytes of token ids; lives in one Python worker."""

    def __init__(self, path: str):
        self.tokens = {rank: token for token, rank in ranks(path).items()}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def gives(self, ids: array, text: str) -> bool:
        """Do the ids decode to the text? PART of them are decoded at a time."""
        data = memoryview(text.encode())
        done = 0
        for start in range(0, len(ids), PART):
            part = self.decode(ids[start : start + PART])
            if data[done : done + len(part)] != part:
                return False
            done += len(part)
        return done == len(data)


def encode(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), intact: str | None = None
) -> DataFrame:
    """The ``keep`` columns and ``ids`` (array of int) of each ``text``, as if without special tokens.

    With ``intact``, a boolean column of that name says whether the ids decode to the text; the worker that encodes a
    text also decodes it, so the bytes need not travel. A NULL or empty text has no ids (an empty array) and is intact.
    Repeated rows are encoded each; columns outside ``keep`` are not read, and ``keep`` may hold neither ``ids`` nor
    the name of the new column.
    """
    place = path or public_tokenizers.path(VOCABULARY)
    added = ["ids"] if intact is None else ["ids", intact]
    if len({*keep, *added}) < len(keep) + len(added):
        raise ValueError(f"kept columns may not be called {' or '.join(added)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(place)
        decoder = Decoder(place) if intact is not None else None
        for batch in batches:
            done = 0
            for texts in portions(batch.column(len(keep))):
                ids = encoder.encode(texts)
                flat = pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in ids]))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                rows = batch.slice(done, len(texts)).columns[: len(keep)]
                found = [pa.ListArray.from_arrays(ends, flat)]
                if decoder is not None:
                    found.append(pa.array(map(decoder.gives, ids, texts), pa.bool_()))
                yield pa.RecordBatch.from_arrays([*rows, *found], [*keep, *added])
                done += len(texts)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    kinds = ("array<int>", "boolean")
    return chosen.mapInArrow(run, ", ".join([*fields, *[f"`{c}` {kind}" for c, kind in zip(added, kinds)]]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of ``ids``. NULL ids stay NULL; an id outside the vocabulary fails."""
    place = path or public_tokenizers.path(VOCABULARY)
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(place)
        for batch in batches:
            data = []
            for ids in batch.column(at):
                values = ids.values
                data.append(None if values is None else decoder.decode(values.to_numpy().tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*names, "decoded"])

    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names]
    chosen = encoded.select(*[F.col(f"`{c}`") for c in names])
    return chosen.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document."""
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
