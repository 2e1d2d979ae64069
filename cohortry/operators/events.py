"""Row-level operators on the log: classes, install types, period slices, monthly totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.period import DEFAULT_ZONE, Period, local_month
from cohortry.functions.vocabulary import VOCABULARY, EventClass


def classify_events(
    activity: DataFrame, vocab: Mapping[str, EventClass] = VOCABULARY, only: list[str] | None = None
) -> DataFrame:
    """The log with one boolean column ``is_<class>`` per event class."""
    names = list(vocab) if only is None else only
    flags = [F.coalesce(vocab[n].hit(), F.lit(False)).alias(f"is_{n}") for n in names]
    return activity.select("*", *flags)


def install_type(vocab: Mapping[str, EventClass] = VOCABULARY, pages: bool = True) -> Column:
    """'fresh' or 'reinstall' of an install event, NULL for the rest.

    With ``pages`` the event must also come from the page of its kind.
    """
    fresh = vocab["fresh"].hit()
    again = vocab["reinstall_wide"].hit()
    if pages:
        fresh = fresh & vocab["fresh_page"].hit()
        again = again & vocab["reinstall_page"].hit()
    return F.when(fresh, "fresh").when(again, "reinstall")


def in_period(activity: DataFrame, period: Period) -> DataFrame:
    """Events of a local-time period; the bounds reach the reader as plain comparisons."""
    return activity.filter(period.log_sql(activity))


def events_per_month(activity: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Per local month: events and distinct active stores; events without a store name no store."""
    per_store = (
        activity.groupBy(local_month("created_at", zone).alias("month"), "store_name")
        .agg(F.count("*").alias("events"))
    )
    return per_store.groupBy("month").agg(
        F.sum("events").alias("events"), F.count("store_name").alias("active_stores")
    )
