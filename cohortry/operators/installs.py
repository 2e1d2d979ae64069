"""Installs of a period: surviving, repeated, re-opened, and what became of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.eligibility import SET_A, PlanFilter
from cohortry.functions.period import Period
from cohortry.functions.vocabulary import VOCABULARY, EventClass
from cohortry.operators.accounts import cohort_accounts
from cohortry.operators.profile import ever, event_profile, holds_after, last, strictly_after
from cohortry.operators.survival import surviving_counts

Vocabulary = Mapping[str, EventClass]


def surviving_installs(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    cohort: str = "new",
    installs: str = "install_any",
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Stores of a cohort whose last install of the period is not followed by churn in it.

    One row per store with the time of that install; churn at the same instant does not count.
    """
    profile = event_profile(
        activity,
        ["store_name"],
        installed=last(vocab[installs], period),
        churned=last(vocab["churn"], period),
    )
    return (
        profile.filter(holds_after("installed", "churned"))
        .join(cohort_accounts(accounts, rule, period, cohort, account_zone), "store_name")
        .select("store_client_id", "store_name", F.col("installed").alias("created_at"))
    )


def surviving_reinstalls(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """Older accounts that re-installed in the period and did not churn after it."""
    return surviving_installs(
        activity, accounts, period, cohort="previous", installs="reinstall", **options
    )


def _status_profile(activity: DataFrame, period: Period, vocab: Vocabulary) -> DataFrame:
    """Per store, the times that decide its install status; one scan of the period."""
    return event_profile(
        activity,
        ["store_name"],
        installed=last(vocab["install_any"], period),
        reinstalled=last(vocab["reinstall"], period),
        reopened=last(vocab["reopen"], period),
        churned=last(vocab["churn"], period),
        left=last(vocab["churn_action"], period),
        last_event=last(None, period),
    )


def _still_open() -> Column:
    """Re-opened, and no close or uninstall among the events at the store's last instant."""
    return F.expr("reopened IS NOT NULL AND (`left` IS NULL OR `left` < last_event)")


def reopened_stores(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Older accounts that re-opened in the period and whose last event in it is not a close."""
    return (
        _status_profile(activity, period, vocab)
        .filter(_still_open())
        .join(cohort_accounts(accounts, rule, period, "previous", account_zone), "store_name")
        .select("store_client_id", "store_name", F.col("reopened").alias("created_at"))
    )


def install_status(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """All three statuses in one pass: rows (store, status, time), status fresh/reinstall/reopen.

    A store of the older cohort can appear both as re-installed and as re-opened.
    """
    previous, new = F.col("cohort") == "previous", F.col("cohort") == "new"

    def status(label: str, condition: Column, moment: str) -> Column:
        return F.when(
            condition, F.struct(F.lit(label).alias("status"), F.col(moment).alias("created_at"))
        )

    statuses = F.array_compact(F.array(
        status("fresh", new & holds_after("installed", "churned"), "installed"),
        status("reinstall", previous & holds_after("reinstalled", "churned"), "reinstalled"),
        status("reopen", previous & _still_open(), "reopened"),
    ))
    return (
        _status_profile(activity, period, vocab)
        .filter("installed IS NOT NULL OR reopened IS NOT NULL")
        .join(cohort_accounts(accounts, rule, period, None, account_zone), "store_name")
        .select("store_client_id", "store_name", F.inline(statuses))
    )


def status_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, how: str = "inner", **options
) -> DataFrame:
    """Fresh, re-installed and re-opened stores side by side per month of the event.

    ``how='inner'`` keeps months that have all three, ``'outer'`` every month with any.
    """
    counts = (
        install_status(activity, accounts, period, **options)
        .groupBy(period.month_of("created_at").alias("month"))
        .agg(
            F.count_if(F.col("status") == "fresh").alias("fresh_count"),
            F.count_if(F.col("status") == "reinstall").alias("re_installs_count"),
            F.count_if(F.col("status") == "reopen").alias("re_open_count"),
        )
    )
    if how == "outer":
        return counts
    return counts.filter("fresh_count > 0 AND re_installs_count > 0 AND re_open_count > 0")


def fresh_count_by_month(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Distinct new stores per month of their surviving install events.

    A store counts in each month that has an install not followed by churn in the whole period. The
    window runs over one row per store and month, not over events.
    """
    measures = {
        "installed": last(vocab["install_any"], period),
        "churned": last(vocab["churn"], period),
    }
    if period.one_month:
        monthly = event_profile(activity, ["store_name"], **measures).withColumn(
            "month", period.month_of("installed")
        )
    else:
        rows = activity.withColumn("month", period.month_of("created_at"))
        monthly = event_profile(rows, ["store_name", "month"], **measures).withColumn(
            "churned", F.max("churned").over(Window.partitionBy("store_name"))
        )
    return (
        monthly.filter(holds_after("installed", "churned"))
        .join(cohort_accounts(accounts, rule, period, "new", account_zone), "store_name")
        .groupBy("month")
        .agg(F.count("*").alias("fresh_count"))
    )


def installs_to_date(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    window: Period,
    cohort: str = "new",
    installs: str = "install_any",
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Stores with an install inside ``window`` that survives to the end of the longer period."""
    profile = event_profile(
        activity,
        ["store_name"],
        installed=last(vocab[installs], period, also=window.sql("created_at")),
        churned=last(vocab["churn"], period),
    )
    return (
        profile.filter(holds_after("installed", "churned"))
        .join(cohort_accounts(accounts, rule, period, cohort, account_zone), "store_name")
        .select("store_client_id", "store_name")
    )


def new_not_reinstalled(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """New stores with a surviving install of which none is a surviving re-install."""
    profile = event_profile(
        activity,
        ["store_name"],
        installed=last(vocab["install_any"], period),
        reinstalled=last(vocab["reinstall"], period),
        churned=last(vocab["churn"], period),
    )
    return (
        profile.filter(
            holds_after("installed", "churned") & ~holds_after("reinstalled", "churned")
        )
        .join(cohort_accounts(accounts, rule, period, "new", account_zone), "store_name")
        .select("store_client_id", "store_name")
    )


def install_multiplicity(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Surviving install events per new store, labelled single or multiple."""
    counts = surviving_counts(activity, period, vocab["install_any"], vocab["churn"])
    count = F.col("events")
    return counts.join(
        cohort_accounts(accounts, rule, period, "new", account_zone), "store_name"
    ).select(
        "store_client_id",
        "store_name",
        count.alias("install_count"),
        F.when(count > 1, "multiple").otherwise("single").alias("install_type"),
    )


def new_install_outcomes(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_A,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Surviving new installs with what they did in the period, all from one pass.

    ``on_free_plan``: a free-plan event not followed by a charge (a charge at the same instant
    counts as following). ``charge_approved``: a charge strictly after the last install.
    ``onboarded``: onboarding completed.
    """
    profile = event_profile(
        activity,
        ["store_name"],
        installed=last(vocab["install_any"], period),
        churned=last(vocab["churn"], period),
        free=last(vocab["free_plan"], period),
        charged=last(vocab["charge_approved"], period),
        onboarded=ever(vocab["onb_done"], period),
    )
    return (
        profile.filter(holds_after("installed", "churned"))
        .join(cohort_accounts(accounts, rule, period, "new", account_zone), "store_name")
        .select(
            "store_client_id",
            "store_name",
            F.col("installed").alias("created_at"),
            strictly_after("free", "charged").alias("on_free_plan"),
            F.expr("coalesce(charged > installed, false)").alias("charge_approved"),
            F.col("charged").alias("latest_charge_approved"),
            "onboarded",
        )
    )


def free_plan_stores(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """Surviving new installs on the free plan."""
    outcomes = new_install_outcomes(activity, accounts, period, **options)
    return outcomes.filter("on_free_plan").select("store_client_id", "store_name")


def paid_stores(activity: DataFrame, accounts: DataFrame, period: Period, **options) -> DataFrame:
    """Surviving new installs with a charge approved after the install."""
    outcomes = new_install_outcomes(activity, accounts, period, **options)
    return outcomes.filter("charge_approved").select(
        "store_client_id",
        "store_name",
        F.col("created_at").alias("fresh_install_date"),
        "latest_charge_approved",
    )


def onboarding_of_new(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """Surviving new installs and whether they completed onboarding in the period."""
    outcomes = new_install_outcomes(activity, accounts, period, **options)
    return outcomes.select("store_client_id", "store_name", "created_at", "onboarded")
