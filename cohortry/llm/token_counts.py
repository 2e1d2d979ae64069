"""Token counts with the whole-token shortcut (operator 10).

Before any text is read, the driver encodes every vocabulary string by itself and keeps those that
stay one token: a list no longer than the vocabulary. A pre-token on that list counts one; only the
others go through the merges of ``merges``. No ids are built.

NULL and empty texts count nothing. Each row is counted by itself, so ties and repeated rows do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import prepare, whole
from cohortry.llm.merges import SPACE, vocabulary

# Merged pre-tokens that a worker process remembers besides the whole tokens.
REMEMBERED = 1_000_000

_counts: dict[str, dict[str, int]] = {}


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that, alone, encode as exactly one token; the proof is the encoding."""
    vocab = vocabulary(path)
    strings = [s.replace(SPACE, " ") for s, t in zip(vocab.symbols, vocab.token, strict=True) if t >= 0]
    return [s for s, ids in zip(strings, vocab.encode_chunks(strings), strict=True) if len(ids) == 1]


def count_texts(texts: list[str], path: str, proved: list[str]) -> list[int]:
    """Number of tokens of each text."""
    vocab, counts = vocabulary(path), _counts.get(path)
    if counts is None or len(counts) > REMEMBERED + len(proved):
        counts = _counts[path] = dict.fromkeys(proved, 1)
    cut = [vocab.chunks(t) for t in texts]
    missing = list(set().union(*cut) - counts.keys())
    counts.update(zip(missing, map(len, vocab.encode_chunks(missing)), strict=True))
    return [sum(map(counts.__getitem__, chunks)) for chunks in cut]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str | Column = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and whether the tokens exceed ``limit``."""
    spark = docs.sparkSession
    prepare(spark)
    # At most as many strings as the vocabulary has pieces.
    proved = spark.sparkContext.broadcast(whole_tokens(path))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array(count_texts(texts.to_pylist(), path, proved.value), dtype=np.int64))

    return docs.select(
        "doc_id",
        F.octet_length(whole(text)).cast("long").alias("n_bytes"),
        count(whole(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
