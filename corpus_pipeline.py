"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Every stage reads all that the stage before it kept, written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldpspark.llm import bpe, linededup, mixing, quality, simhash
from ldpspark.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the bands of tokenizer fertility."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three lines or more are cut out; ``n_chars`` follows the text."""
    cut = linededup.clean(docs)
    return cut.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in cut.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, in shuffled shards."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens, intact``: token ids, and whether they decode to the text."""
    found = bpe.encode(docs, keep=("doc_id", "lang", "source"), intact="intact")
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "intact")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("mixing", mixed),
    ("byte-level bpe", encoded),
]

# tokenizers cannot be said in SQL; tests/llm holds the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
