"""Per-key profiles of the log: the one place where the log is shuffled.

"No later event", "last event" and "some event at or after" all reduce to comparing the latest
times of two event classes per key. One ``groupBy`` with conditional maxima gives those times, so
the log is read once, never joined with itself, and a key with any number of events travels as one
row per map task. Joins with accounts come after, on one row per key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.period import Period
from cohortry.functions.vocabulary import EventClass, union

STORE_KEYS = ("store_client_id", "store_name")


@dataclass(frozen=True)
class Measure:
    """An aggregate over the events of a class (any event for None) in a scope.

    ``template`` is the aggregate with ``{hit}`` for the condition. ``scope`` is a period of the
    log, None the whole log. ``also`` narrows the class further. ``merge`` is the aggregate that makes
    one value of several of the same key.
    """

    template: str
    cls: EventClass | None
    scope: Period | None = None
    also: str | None = None
    merge: str = "max"

    @property
    def is_flag(self) -> bool:
        return self.merge == "bool_or"

    def column(self, scoped: bool, lowered: bool) -> Column:
        tests = [self.scope.sql("created_at")] if scoped and self.scope else []
        tests += [self.cls.sql(lowered)] if self.cls else []
        tests += [self.also] if self.also else []
        return F.expr(self.template.format(hit=" AND ".join(tests) or "true"))


def last(cls: EventClass | None, scope: Period | None = None, also: str | None = None) -> Measure:
    """Latest event time."""
    return Measure("max(CASE WHEN {hit} THEN created_at END)", cls, scope, also)


def first(cls: EventClass | None, scope: Period | None = None, also: str | None = None) -> Measure:
    """Earliest event time."""
    return Measure("min(CASE WHEN {hit} THEN created_at END)", cls, scope, also, "min")


def ever(cls: EventClass | None, scope: Period | None = None, also: str | None = None) -> Measure:
    """Whether there is such an event."""
    return Measure("coalesce(bool_or({hit}), false)", cls, scope, also, "bool_or")


def times(cls: EventClass | None, scope: Period | None = None, also: str | None = None) -> Measure:
    """Number of such events."""
    return Measure("count_if({hit})", cls, scope, also, "sum")


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def _rows_of(log: DataFrame, scope: Period | None, classes: list[EventClass | None]) -> str:
    """The rows that measures of one scope look at: one list of labels for all their classes."""
    tests = [scope.log_sql(log)] if scope else []
    if None not in classes:
        tests.append(union(*classes).sql())
    return f"({' AND '.join(tests) or 'true'})"


def event_profile(activity: DataFrame, keys: list[str], **measures: Measure) -> DataFrame:
    """One row per key with the named measures.

    Rows no measure looks at are dropped before the aggregation, by one filter per scope; so are
    rows without a store, which are no store's events. Labels are lower-cased once per row.
    """
    by_scope: dict[Period | None, list[EventClass | None]] = {}
    for measure in measures.values():
        by_scope.setdefault(measure.scope, []).append(measure.cls)
    relevant = " OR ".join(_rows_of(activity, *rows) for rows in by_scope.items())
    known = " AND ".join(f"{key} IS NOT NULL" for key in keys if key in STORE_KEYS)
    rows = activity.filter(f"({relevant}) AND {known or 'true'}")
    classes = [measure.cls for measure in measures.values() if measure.cls]
    lowered = bool(classes) and all(cls.fold_case for cls in classes)
    if lowered:
        rows = rows.withColumns({"action": F.lower("action"), "page": F.lower("page")})
    mixed = len(by_scope) > 1
    return rows.groupBy(*keys).agg(
        *(measure.column(mixed, lowered).alias(name) for name, measure in measures.items())
    )


def holds_after(event: str, other: str) -> Column:
    """The event happened, and nothing of the other kind strictly later (a tie holds)."""
    return F.expr(f"({event} IS NOT NULL AND ({other} IS NULL OR {event} >= {other}))")


def strictly_after(event: str, other: str) -> Column:
    """The event happened, and nothing of the other kind at the same time or later."""
    return F.expr(f"({event} IS NOT NULL AND ({other} IS NULL OR {event} > {other}))")


def resolved_profile(
    activity: DataFrame, accounts: DataFrame, keys: list[str], **measures: Measure
) -> DataFrame:
    """One row per account id and ``keys``: an event belongs to the account that has its store name,
    whatever id it carries itself. Events of unknown names are left out.

    The log is aggregated by store name; only those profiles meet the accounts, are re-keyed and merged,
    since an account can have had several names.
    """
    by_name = event_profile(activity, ["store_name", *keys], **measures)
    named = by_name.join(accounts.select("store_name", "store_client_id"), "store_name")
    return named.groupBy("store_client_id", *keys).agg(
        *(F.expr(f"{measure.merge}({name})").alias(name) for name, measure in measures.items())
    )
