"""State of a store at the end of each month, and what hangs on it.

The last lifecycle event of a (store, month) decides: an install means installed. Events at the same
instant all count as last, so a tie of install and uninstall leaves the store installed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.eligibility import SET_B, PlanFilter
from cohortry.functions.period import Period
from cohortry.functions.vocabulary import VOCABULARY, EventClass, union
from cohortry.operators.accounts import eligible_accounts, excluded_accounts
from cohortry.operators.profile import (
    Measure,
    ever,
    event_profile,
    holds_after,
    last,
    resolved_profile,
)

Vocabulary = Mapping[str, EventClass]
ACCOUNT_ID = "store_client_id"


def _month_ends(
    activity: DataFrame,
    period: Period,
    vocab: Vocabulary,
    accounts: DataFrame | None = None,
    **extra: Measure,
) -> DataFrame:
    """Installed (store, month) pairs of the period, with extra measures.

    With accounts, events are theirs by store name and the id is the account's; without, stores are
    told apart by the id in the log.
    """
    rows = activity.withColumn("month", period.month_of("created_at"))
    measures = {
        "installed": last(union(vocab["fresh"], vocab["reinstall_wide"]), period),
        "removed": last(vocab["uninstall_only"], period),
        **extra,
    }
    if accounts is None:
        profile = event_profile(rows, [ACCOUNT_ID, "month"], **measures)
    else:
        profile = resolved_profile(rows, accounts, ["month"], **measures)
    return profile.filter(holds_after("installed", "removed"))


def _created_before(
    accounts: DataFrame | None, before: Period | None, account_zone: str | None
) -> DataFrame | None:
    """Accounts created before a period; None when there is no such period."""
    if before is None:
        return None
    return accounts.filter(before.in_zone(account_zone).before("created_on"))


def installed_at_month_end(
    activity: DataFrame,
    period: Period,
    accounts: DataFrame | None = None,
    before: Period | None = None,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Stores installed at the end of each month of the period, with the time of that install.

    With ``accounts`` and ``before``, only accounts created before the start of ``before``; their events
    are found by store name, so the one id throughout is the account's.
    """
    older = _created_before(accounts, before, account_zone)
    states = _month_ends(activity, period, vocab, older)
    return states.select(ACCOUNT_ID, "month", F.col("installed").alias("created_at"))


def onboarding_at_month_end(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    before: Period | None = None,
    rule: PlanFilter = SET_B,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Installed (store, month) pairs outside the excluded plans, with the onboarding state.

    ``onboarded`` tells whether onboarding was completed in that calendar month. An unknown plan is
    not an excluded one. With ``before``, see :func:`installed_at_month_end`.
    """
    done = ever(vocab["onb_done"], period.whole_months())
    kept = eligible_accounts(accounts, rule.keeping_null_plan())
    older = _created_before(kept, before, account_zone)
    states = _month_ends(activity, period, vocab, older, onboarded=done)
    if before is None:
        excluded = excluded_accounts(accounts, rule).select(ACCOUNT_ID)
        states = states.join(excluded, ACCOUNT_ID, "left_anti")
    return states.select(
        ACCOUNT_ID, "month", F.col("installed").alias("created_at"), "onboarded"
    )


def onboarding_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, state: str, **options
) -> DataFrame:
    """Stores per month that were installed at its end and completed or still owe onboarding."""
    names = {"completed": "completed_same_month", "pending": "pending_in_month"}
    wanted = F.col("onboarded") if state == "completed" else ~F.col("onboarded")
    return (
        onboarding_at_month_end(activity, accounts, period, **options)
        .groupBy("month")
        .agg(F.count_if(wanted).alias(names[state]))
    )


def _scopes(period: Period, scope: str) -> tuple[Period | None, Period | None]:
    """Where the events that decide the state lie, and those that may follow it."""
    return (period, period.onwards()) if scope == "period" else (None, None)


def converted_after_install(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    scope: str = "period",
    rule: PlanFilter = SET_B,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Stores whose last lifecycle event is an install and that upgraded at or after it.

    ``scope='period'`` looks at lifecycle events of the period, ``'before'`` at the whole log of
    accounts created before it. A re-install must come from the re-install page; a fresh install
    counts from any page, but is typed 'fresh' only from its own.
    """
    inside, since = _scopes(period, scope)
    profile = event_profile(
        activity,
        [ACCOUNT_ID],
        last_event=last(vocab["lifecycle"], inside),
        fresh=last(vocab["fresh"], inside),
        fresh_on_page=last(vocab["fresh"], inside, also=vocab["fresh_page"].sql()),
        again=last(vocab["reinstall_wide"], inside, also=vocab["reinstall_page"].sql()),
        upgraded=last(vocab["upgraded"], since),
    )
    kept = eligible_accounts(accounts, rule.keeping_null_plan())
    if scope == "before":
        kept = kept.filter(period.in_zone(account_zone).before("created_on"))
    return (
        profile.filter("greatest(fresh, again) = last_event AND upgraded >= last_event")
        .join(kept.select(ACCOUNT_ID), ACCOUNT_ID, "left_semi")
        .select(
            ACCOUNT_ID,
            F.col("last_event").alias("created_at"),
            F.expr("coalesce(fresh_on_page = last_event, false)").alias("is_fresh"),
            F.expr("coalesce(again = last_event, false)").alias("is_reinstall"),
        )
    )


def free_without_upgrade(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    scope: str = "period",
    rule: PlanFilter = SET_B,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Installed (store, month) pairs with a free event that no upgrade of that month follows.

    The free event may come in any later month; an upgrade at the same instant follows it. The
    latest free event is the best candidate for both tests, so one time per store is enough. The
    window that carries it across months runs over one row per store and month.
    """
    inside, since = _scopes(period, scope)
    months = event_profile(
        activity.withColumn("month", period.month_of("created_at")),
        [ACCOUNT_ID, "month"],
        fresh=last(vocab["fresh"], inside),
        again=last(vocab["reinstall_wide"], inside),
        removed=last(vocab["uninstall_only"], inside),
        free=last(vocab["free_or_downgraded"], since),
        upgraded=last(vocab["upgraded"], since),
    ).withColumn("free", F.max("free").over(Window.partitionBy(ACCOUNT_ID)))
    kept = eligible_accounts(accounts, rule.keeping_null_plan())
    if scope == "before":
        kept = kept.filter(period.in_zone(account_zone).before("created_on"))
    return (
        months.withColumn("installed", F.greatest("fresh", "again"))
        .filter(holds_after("installed", "removed"))
        .filter("free >= installed AND (upgraded IS NULL OR free > upgraded)")
        .join(kept.select(ACCOUNT_ID), ACCOUNT_ID, "left_semi")
        .select(
            ACCOUNT_ID,
            "month",
            F.col("installed").alias("created_at"),
            F.expr("coalesce(fresh = installed, false)").alias("is_fresh"),
            F.expr("coalesce(again = installed, false)").alias("is_reinstall"),
        )
    )
