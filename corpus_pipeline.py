"""A training-corpus pipeline of five stages over the documents table.

Each stage works on what its predecessor kept, written as Parquet and read again in between. All but
the last return the columns of ``documents``, unchanged and whatever their names; no text is cut, very long
ones included.

NULL and empty texts have too few words and leave in the first stage. Of repeated rows and of rows that lack
an id one stays where their texts are equal or similar; a NULL id is kept as it is. A NULL source is a
source of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import compression_bands, content_sort, mixing, prefix_join, sentencepiece_codec
from cohortry.llm.common import shared_folder, stored
from cohortry.llm.queries import tokenizer_path

# Chunks that a worker remembers here: executors also hold what the stages before have left.
REMEMBERED = 40_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the compression bands go."""
    return compression_bands.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return content_sort.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays."""
    return prefix_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once for every pass of the mix that takes them."""
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document."""
    coded = sentencepiece_codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), remembered=REMEMBERED)
    return sentencepiece_codec.digests(coded)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# Compression ratios and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
