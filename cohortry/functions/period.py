"""Local-time periods over UTC columns.

Event and account times are TIMESTAMP_NTZ in UTC. A period is a half-open range of local time; its
bounds are shifted to UTC once, so a filter compares the bare column and reaches the Parquet reader.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ZONE = "+05:30"
EVENT_TIME = "created_at"
# Metadata of a log column that holds the UTC day of the event time.
DAY_MARK = "utc_day_of"
_OFFSET = re.compile(r"([+-])(\d{2}):(\d{2})")


def _fixed_offset(zone: str) -> timedelta | None:
    """The offset of '+hh:mm', None for a zone name."""
    match = _OFFSET.fullmatch(zone)
    if match is None:
        return None
    sign, hours, minutes = match.groups()
    shift = timedelta(hours=int(hours), minutes=int(minutes))
    return -shift if sign == "-" else shift


def _day(value: date | str) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def ntz(moment: datetime) -> str:
    """A TIMESTAMP_NTZ literal, independent of the session and driver time zones."""
    return f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ', timespec='microseconds')}'"


def local_time(column: str, zone: str = DEFAULT_ZONE) -> str:
    """SQL text: a UTC column as local wall-clock time."""
    shift = _fixed_offset(zone)
    if shift is None:
        return f"convert_timezone('UTC', '{zone}', {column})"
    if not shift:
        return column
    return f"({column} + INTERVAL '{int(shift.total_seconds() // 60)}' MINUTE)"


def local_month(column: str, zone: str = DEFAULT_ZONE) -> Column:
    """First day of the local month of a UTC column."""
    return F.expr(f"trunc(CAST({local_time(column, zone)} AS DATE), 'MM')")


def month_label(column: str | Column) -> Column:
    """'YYYY-MM' of a month column; for output only."""
    return F.date_format(column, "yyyy-MM")


def stored_by_day(log: DataFrame, day_column: str) -> DataFrame:
    """The log, with the statement that a column is the UTC day of the event time in every row.

    Period filters then bound that column too. A column that merely has such a name is left alone.
    """
    return log.withMetadata(day_column, {DAY_MARK: EVENT_TIME})


# The present moment in UTC without a zone. Spark takes one time for a whole query and folds it to a
# literal before filters are pushed down, whatever the session's zone.
NOW = "convert_timezone(current_timezone(), 'UTC', localtimestamp())"


@dataclass(frozen=True)
class Period:
    """Local range [lo, hi); a missing bound is open. With ``to_now`` the range ends at the moment the
    query runs, that moment included."""

    lo: datetime | None
    hi: datetime | None
    zone: str = DEFAULT_ZONE
    to_now: bool = False

    @classmethod
    def days(cls, first: date | str, last: date | str, zone: str = DEFAULT_ZONE) -> Period:
        """Whole local days, both named days included."""
        return cls(
            datetime.combine(_day(first), time()),
            datetime.combine(_day(last) + timedelta(days=1), time()),
            zone,
        )

    @classmethod
    def month(cls, label: str, zone: str = DEFAULT_ZONE) -> Period:
        """The calendar month 'YYYY-MM'."""
        first = date.fromisoformat(f"{label}-01")
        return cls.days(first, first.replace(day=calendar.monthrange(first.year, first.month)[1]), zone)

    @classmethod
    def through(cls, last: date | str, zone: str = DEFAULT_ZONE) -> Period:
        """Everything up to and including a local day."""
        return cls(None, datetime.combine(_day(last) + timedelta(days=1), time()), zone)

    @classmethod
    def until(
        cls, first: date | str, as_of: datetime | None = None, zone: str = DEFAULT_ZONE
    ) -> Period:
        """From a local day to a local moment, that moment included. Without ``as_of`` the end is the
        present, found in each query that uses the period."""
        start = datetime.combine(_day(first), time())
        if as_of is None:
            return cls(start, None, zone, to_now=True)
        return cls(start, as_of + timedelta(microseconds=1), zone)

    def _utc(self, moment: datetime | None) -> datetime | None:
        if moment is None:
            return None
        shift = _fixed_offset(self.zone)
        if shift is not None:
            return moment - shift
        aware = moment.replace(tzinfo=ZoneInfo(self.zone))
        return aware.astimezone(timezone.utc).replace(tzinfo=None)

    def utc_bounds(self) -> tuple[datetime | None, datetime | None]:
        return self._utc(self.lo), self._utc(self.hi)

    def in_zone(self, zone: str | None) -> Period:
        """The same wall-clock bounds read in another zone; unchanged for None."""
        return self if zone is None else replace(self, zone=zone)

    def onwards(self) -> Period:
        """From the start, without an end."""
        return replace(self, hi=None, to_now=False)

    def so_far(self) -> Period:
        """Everything up to the end."""
        return replace(self, lo=None)

    def sql(self, column: str) -> str:
        """The period as SQL text on a UTC column."""
        lo, hi = self.utc_bounds()
        tests = [f"{column} >= {ntz(lo)}"] if lo else []
        tests += [f"{column} < {ntz(hi)}"] if hi else []
        tests += [f"{column} <= {NOW}"] if self.to_now else []
        return f"({' AND '.join(tests) or 'true'})"

    def log_sql(self, log: DataFrame) -> str:
        """The period as SQL text on a log.

        A log that :func:`stored_by_day` has marked is also bounded on its day column, which prunes
        directories.
        """
        lo, hi = self.utc_bounds()
        tests = []
        for field in log.schema.fields:
            if field.metadata.get(DAY_MARK) == EVENT_TIME:
                tests += [f"`{field.name}` >= DATE'{lo.date()}'"] if lo else []
                tests += [f"`{field.name}` <= DATE'{hi.date()}'"] if hi else []
                tests += [f"`{field.name}` <= CAST({NOW} AS DATE)"] if self.to_now else []
        return " AND ".join([*tests, self.sql(EVENT_TIME)])

    def before_sql(self, column: str) -> str:
        """Before the start, as SQL text."""
        lo, _ = self.utc_bounds()
        return f"({column} < {ntz(lo)})" if lo else "false"

    def contains(self, column: str) -> Column:
        return F.expr(self.sql(column))

    def before(self, column: str) -> Column:
        return F.expr(self.before_sql(column))

    def month_of(self, column: str) -> Column:
        return local_month(column, self.zone)

    @property
    def last_day(self) -> date:
        if self.hi is None:
            raise ValueError("a period without an end has no last day")
        return (self.hi - timedelta(microseconds=1)).date()

    @property
    def one_month(self) -> bool:
        """True when the whole period lies in one local calendar month."""
        if self.lo is None or self.hi is None:
            return False
        return (self.lo.year, self.lo.month) == (self.last_day.year, self.last_day.month)

    def whole_months(self) -> Period:
        """The period widened to full calendar months; the month of the present has no end yet."""
        lo = self.lo and self.lo.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        hi = self.hi and datetime.combine(
            self.last_day.replace(
                day=calendar.monthrange(self.last_day.year, self.last_day.month)[1]
            )
            + timedelta(days=1),
            time(),
        )
        return replace(self, lo=lo, hi=hi, to_now=False)


def month_spine(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row per month between two date columns of a frame, both months included; any length."""
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))
    return bounds.select(F.explode(months).alias("month"))


def period_months(spark: SparkSession, period: Period) -> DataFrame:
    """The month spine of a closed period, or of one up to the present; ValueError for an open one."""
    if period.lo is None or period.hi is None and not period.to_now:
        raise ValueError("the months of an open period cannot be listed")
    today = F.expr(f"CAST({local_time(NOW, period.zone)} AS DATE)")
    bounds = spark.range(1).select(
        F.lit(period.lo.date()).alias("first"),
        (today if period.to_now else F.lit(period.last_day)).alias("last"),
    )
    return month_spine(bounds)
