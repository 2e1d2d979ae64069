"""Whole-log facts of the few stores that a period selects.

The facts look at the whole log, the stores come from one period of it. So the log is cut down to those
stores before it is aggregated: their keys are hashed to the bits of a fixed bitmap, 64 to a row, and the
log meets it in a broadcast join below the partial aggregation. The bitmap has at most ``SLOTS / 64``
rows of two numbers however many stores there are, so the broadcast is safe at any size; with very many
stores more bits are set and less of the log is left out, never a row of a selected store. Other stores
that share a bit leave when the facts are joined to the stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.profile import Measure, event_profile

# Bits of the bitmap, a power of two: 262,144 rows at most, some 8 MB in memory. A million stores set 6 % of them.
SLOTS = 1 << 24


def _slot(key: str) -> str:
    # Never NULL, also by type: a test for that would keep Spark from reading the period only once.
    return f"(xxhash64({key}) & {SLOTS - 1}L)"


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """``word`` and ``bits``: the bitmap of a column's values, NULL left out, without its empty words."""
    slot = _slot(key)
    rows = keys.selectExpr(
        f"shiftright({slot}, 6) AS word",
        f"CASE WHEN {key} IS NOT NULL THEN shiftleft(1L, CAST({slot} & 63 AS INT)) END AS bit")
    return rows.groupBy("word").agg(F.expr("bit_or(bit) AS bits"))


def rows_of(log: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the log whose key is, or shares a bit with, one of ``keys``; all its columns."""
    slot = _slot(key)
    slotted = log.selectExpr("*", f"shiftright({slot}, 6) AS word", f"CAST({slot} & 63 AS INT) AS place")
    marked = slotted.join(F.broadcast(key_bits(keys, key)), "word")
    return marked.filter("shiftright(bits, place) & 1L = 1L").select(*log.columns)


def with_facts(stores: DataFrame, activity: DataFrame, key: str, **facts: Measure) -> DataFrame:
    """The stores, one row each, with measures over the whole log. Flags of stores without such events
    are false."""
    found = event_profile(rows_of(activity, stores, key), [key], **facts)
    values = [
        f"coalesce({name}, false) AS {name}" if measure.is_flag else name for name, measure in facts.items()]
    return stores.join(found, key, "left").selectExpr(*stores.columns, *values)
