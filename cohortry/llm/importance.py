"""Target-distribution importance resampling on hashed n-grams (operator 13).

Texts go through Arrow kernels, a batch at a time: lower-cased, split into words, flattened and
dictionary-encoded. Shifted dictionary indices form the n-grams; each distinct n-gram of a batch is
hashed once, by carrying the crc32 of its prefix on over its last word. Two passes over the texts use
that: the first counts features by bucket, the second takes each feature's gain and sums them by
document. Between the passes one row a bucket reaches the driver, a number fixed by ``buckets``.

A document's score is its weight, the floored mean gain, plus Gumbel noise drawn from a hash of its
id, so the highest scores are a sample without replacement in proportion to the exponential of the
weight. Ranks come from ranges of the score order and the row counts of the earlier ranges.

NULL and empty texts have no features and weight 0. Very long texts are never cut. Rows that share an
id share their noise and are ranked separately; a NULL id counts as empty text in the hash and ranks
behind others of equal score. Rows alike in score, id, weight and length are ranked in the order in
which they are stored. An empty table gives an empty result. Only ``doc_id`` and the text column are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import prepare, shared_folder, stored, whole

# What separates words: every ASCII character that is neither a digit nor a lower-case letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Sampling:
    """Features are runs of 1 to ``most_words`` words; ``percent`` of the documents with at least
    ``least_words`` words are drawn."""

    most_words: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


@dataclass(frozen=True)
class Features:
    """Of a batch of texts: words per text, and for each feature its text and its distinct n-gram."""

    n_words: np.ndarray
    owner: np.ndarray
    gram: np.ndarray
    crc: np.ndarray


def features(texts: pa.Array, most_words: int) -> Features:
    """All runs of 1 to ``most_words`` words of each text, NULL as empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(lowered, pattern=GAP)
    pieces, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    kept = pc.greater(pc.binary_length(pieces), 0)
    encoded = pc.dictionary_encode(pieces.filter(kept))
    owner = np.asarray(owner.filter(kept), dtype=np.int64)
    index = np.asarray(encoded.indices, dtype=np.int64)
    words = [word.encode() for word in encoded.dictionary.to_pylist()]
    gram, crc = index, np.array([zlib.crc32(word) for word in words], dtype=np.uint32)
    owners, grams, crcs, known = [owner], [gram], [crc], len(crc)
    for width in range(2, most_words + 1):
        # Position i continues the run of one word less that starts there with the word behind it.
        if len(owner) < width:
            break
        inside = owner[: len(owner) - width + 1] == owner[width - 1 :]
        pairs = gram[: len(inside)] * len(words) + index[width - 1 :]
        distinct, gram = np.unique(pairs, return_inverse=True)
        crc = np.array(
            [zlib.crc32(b" " + words[pair % len(words)], int(crc[pair // len(words)])) for pair in distinct.tolist()],
            dtype=np.uint32)
        owners.append(owner[: len(inside)][inside])
        grams.append(gram[inside] + known)
        crcs.append(crc)
        known += len(crc)
    return Features(
        np.bincount(owner, minlength=len(texts)), np.concatenate(owners), np.concatenate(grams),
        np.concatenate(crcs))


def bucket_counts(docs: DataFrame, sampling: Sampling = Sampling(), text: str = "text") -> DataFrame:
    """``bucket`` and the number of features in it, empty buckets left out."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(sampling.buckets, dtype=np.int64)
        for batch in batches:
            found = features(batch.column(0), sampling.most_words)
            seen = np.bincount(found.gram, minlength=len(found.crc))
            np.add.at(totals, found.crc % sampling.buckets, seen)
        filled = np.flatnonzero(totals)
        yield pa.record_batch({"bucket": pa.array(filled, pa.int32()), "n": pa.array(totals[filled])})

    partial = docs.select(whole(text).alias("text")).mapInArrow(count, "bucket int, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, sampling: Sampling = Sampling()) -> np.ndarray:
    """Of every bucket, 1000 times the log ratio of its smoothed shares in target and corpus, floored.

    Both frames come from :func:`bucket_counts` and have one row a bucket at most.
    """
    sides = []
    for counts in (corpus, target):
        per_bucket = np.zeros(sampling.buckets, dtype=np.int64)
        for row in counts.collect():
            per_bucket[row["bucket"]] = row["n"]
        sides.append(per_bucket)
    corpus_total, target_total = (float(side.sum() + sampling.buckets) for side in sides)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * corpus_total / (float(s + 1) * target_total)))
        for s, t in zip(sides[0].tolist(), sides[1].tolist(), strict=True)
    ], dtype=np.int64)


def weighed_texts(texts: pa.Array, gain: np.ndarray, most_words: int) -> tuple[np.ndarray, ...]:
    """Number of words, number of features and weight of each text."""
    found = features(texts, most_words)
    per_feature = np.take(gain[found.crc % len(gain)] if len(found.crc) else gain[:0], found.gram)
    order = np.argsort(found.owner, kind="stable")
    n = np.bincount(found.owner, minlength=len(texts))
    # Segments of empty texts are left out: reduceat would give them their neighbour's first value.
    filled = np.flatnonzero(n)
    weight = np.zeros(len(texts), dtype=np.int64)
    if len(filled):
        starts = (np.cumsum(n) - n)[filled]
        weight[filled] = np.add.reduceat(per_feature[order], starts) // n[filled]
    return found.n_words, n, weight


def weighed(docs: DataFrame, gain: np.ndarray, sampling: Sampling = Sampling(), text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each document."""
    prepare(docs.sparkSession)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            columns = weighed_texts(texts, gain, sampling.most_words)
            yield pa.StructArray.from_arrays(
                [pa.array(c.astype(np.int64)) for c in columns], ["n_words", "n_features", "weight"])

    return docs.select("doc_id", weigh(whole(text)).alias("found")).select("doc_id", "found.*")


def scored(weights: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Adds ``score``: the weight plus noise that depends on the id alone."""
    named = F.concat(F.lit(f"{sampling.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digits = F.substring(F.sha2(named.cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))
    return weights.withColumn("score", F.col("weight") + noise.cast("long"))


def drawn(scores: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Adds ``rank`` 1, 2, 3 … of the drawn rows, NULL for the others.

    Long enough rows are dealt to ranges of the score order and stored with their range; a range's
    first rank follows from the sizes of the ranges before it, one row a range. No task sees more than
    its range, and rows alike in score and id do not share one: their place in the table decides.
    """
    spark = scores.sparkSession
    folder = shared_folder(spark)
    held = stored(scores.withColumn("place", F.monotonically_increasing_id()), folder, "scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "place"]
    eligible = F.col("n_words") >= sampling.least_words
    ranges = stored(
        held.filter(eligible).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), folder, "ranges")
    parts = ranges.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.floor(F.sum("rows").over(every) * sampling.percent / 100).alias("quota"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = (F.col("before") + within).cast("long")
    ranked = ranges.join(parts, "part").withColumn("rank", rank).withColumn(
        "rank", F.when(F.col("rank") <= F.col("quota"), F.col("rank")))
    short = held.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    columns = [*scores.columns, "rank"]
    return ranked.select(*columns).unionByName(short.select(*columns))


def resample(docs: DataFrame, target: DataFrame, sampling: Sampling = Sampling(), text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of each document,
    drawn to resemble the texts of ``target``."""
    gain = gains(bucket_counts(docs, sampling, text), bucket_counts(target, sampling, text), sampling)
    return drawn(scored(weighed(docs, gain, sampling, text), sampling), sampling)
