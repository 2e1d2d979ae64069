"""Which events of a period outlive the last event of another kind, one scan and no join back.

"No later churn" asks each event for a later one of its store, and a store can hold a third of the log.
So the events of a store are dealt out by hour: (store, hour) is a cell, small however many events the
store has. Inside a cell a window finds the last opposing event; what the store's other cells hold
reaches it through a carry, one row a cell, which alone meets by store. The events themselves are
shuffled once, by cell, and both steps use that shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.period import Period
from cohortry.functions.vocabulary import EventClass
from cohortry.operators.events import in_period

KEY = "store_name"
CELL = [KEY, "cell"]
# Hours since 1970, of the wall clock that the log is written in.
HOUR = "coalesce(unix_date(CAST(created_at AS DATE)) * 24 + hour(created_at), 0)"


def _celled(events: DataFrame) -> DataFrame:
    """The events dealt out by store and hour."""
    return events.withColumn("cell", F.expr(HOUR)).repartition(*CELL)


def _events_of(activity: DataFrame, period: Period, kept: EventClass, ending: EventClass, columns: list[str]) -> DataFrame:
    """Events of either class in the period: ``event`` has the columns of kept events and is NULL for
    others, ``ends_at`` is the time of opposing ones."""
    rows = in_period(activity, period).filter(f"{KEY} IS NOT NULL AND {(kept | ending).sql()}")
    return rows.select(
        KEY, "created_at",
        F.when(kept.hit(), F.struct(*columns)).alias("event"),
        F.when(ending.hit(), F.col("created_at")).alias("ends_at"))


def surviving_counts(activity: DataFrame, period: Period, kept: EventClass, ending: EventClass) -> DataFrame:
    """``store_name`` and the ``events`` of a class that none of the other is strictly later than, of
    stores that have any."""
    rows = _celled(_events_of(activity, period, kept, ending, ["created_at"]))
    rows = rows.withColumn("ended", F.max("ends_at").over(Window.partitionBy(*CELL)))
    cells = rows.groupBy(*CELL).agg(
        F.min("created_at").alias("first_at"),
        F.max("ended").alias("ended"),
        F.count("event").alias("all"),
        F.count_if(F.expr("event IS NOT NULL AND (ended IS NULL OR created_at >= ended)")).alias("after"),
    )
    # Cells do not overlap in time: one holds the store's last ending, the others lie before or behind it.
    cells = cells.withColumn("last_end", F.max("ended").over(Window.partitionBy(KEY)))
    outlive = F.expr("""CASE WHEN last_end IS NULL OR first_at > last_end THEN `all`
        WHEN ended = last_end THEN after ELSE 0 END""")
    return cells.groupBy(KEY).agg(F.sum(outlive).alias("events")).filter("events > 0")


def surviving_events(
    activity: DataFrame,
    period: Period,
    kept: EventClass,
    ending: EventClass,
    stores: DataFrame,
    columns: list[str],
) -> DataFrame:
    """The events of a class that none of the other is strictly later than, with ``columns`` of the log
    and those of ``stores``, which has one row a store. Other stores are left out."""
    held = ["created_at", *columns]
    rows = _celled(_events_of(activity, period, kept, ending, held)).drop("created_at")
    carry = rows.groupBy(*CELL).agg(
        F.max("ends_at").alias("ended"), F.max(F.col("event").isNotNull()).alias("has_kept"))
    carry = carry.withColumn("ended", F.max("ended").over(Window.partitionBy(KEY)))
    carry = carry.filter("has_kept").drop("has_kept").join(stores, KEY)
    # Both sides use every column behind the shuffle and nothing of the condition can be tested before it,
    # so Spark shuffles once for both. An event's own ``ends_at`` is never later than ``ended``.
    outlives = """CASE WHEN greatest(ended, ends_at) IS NULL THEN event IS NOT NULL
        ELSE event IS NOT NULL AND event.created_at >= greatest(ended, ends_at) END"""
    return rows.join(carry, CELL).filter(outlives).select(
        KEY, *(c for c in stores.columns if c != KEY), *(f"event.{c}" for c in held))
