"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored


def _min_of(edges: DataFrame) -> DataFrame:
    """Per left end, the smallest right end; partial aggregates first, so hot ends shrink early."""
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _min_of(both).select("a", F.least("low", "a").alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _min_of(down)
    moved = down.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``a`` and the smallest node ``b`` of its component, for every node that is not that one.

    ``edges`` has columns ``a`` and ``b`` of one sortable type; equal ends are ignored. Each round is
    written to ``folder``, so a lost executor costs one round at most.
    """
    found = stored(edges.filter("a != b").select("a", "b").distinct(), folder, f"{name}-0")
    seen, turn = None, 0
    while True:
        turn += 1
        found = stored(_small(_large(found)), folder, f"{name}-{turn}")
        state = found.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return found
        seen = state
