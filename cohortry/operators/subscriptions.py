"""Paid and free accounts: current plan, first payment, stored snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.eligibility import SET_B, PlanFilter
from cohortry.functions.period import Period, month_label, period_months
from cohortry.functions.vocabulary import VOCABULARY, EventClass
from cohortry.operators.accounts import eligible_accounts
from cohortry.operators.profile import ever, event_profile, first

Vocabulary = Mapping[str, EventClass]


def active_accounts(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_B,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Accounts created before the period that installed at some time and never churned."""
    kept = eligible_accounts(accounts, rule).filter(
        period.in_zone(account_zone).before("created_on")
    )
    never_left = event_profile(
        activity, ["store_name"],
        installed=ever(vocab["install_any"]), churned=ever(vocab["churn"]),
    ).filter("installed AND NOT churned")
    return kept.join(never_left.select("store_name"), "store_name", "left_semi").select(
        "store_client_id", "store_name", "charge_approve", "status"
    )


def active_by_plan(activity: DataFrame, accounts: DataFrame, period: Period, **options) -> DataFrame:
    """One row: active accounts on the free and on the paid plan."""
    free = F.expr("status = '1' AND charge_approve IN ('0', '2')")
    paid = F.expr("status = '1' AND charge_approve = '1'")
    return active_accounts(activity, accounts, period, **options).agg(
        F.count_if(free).alias("free_plan_active_merchants"),
        F.count_if(paid).alias("paid_plan_active_merchants"),
    )


def first_paid(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_B,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Older accounts whose first paid event ever falls in the period.

    Accounts with an uninstall page up to the end of the period are left out. Later events cannot
    change either answer, so the scan stops at the end of the period.
    """
    so_far = period.so_far()
    profile = event_profile(
        activity, ["store_name"],
        first_paid_at=first(vocab["pricing_plan"], so_far),
        left=ever(vocab["uninstall_page"], so_far),
    )
    kept = eligible_accounts(accounts, rule).filter(
        period.in_zone(account_zone).before("created_on")
    )
    return (
        profile.filter(period.contains("first_paid_at")).filter("NOT `left`")
        .join(kept.select("store_client_id", "store_name"), "store_name")
        .select("store_client_id", "store_name", "first_paid_at")
    )


def first_paid_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """First payments per month over every month of the period, zero where there are none."""
    counts = (
        first_paid(activity, accounts, period, **options)
        .groupBy(period.month_of("first_paid_at").alias("month"))
        .agg(F.count("*").alias("total_stores"))
    )
    spine = period_months(activity.sparkSession, period)
    return spine.join(counts, "month", "left").select(
        "month", F.coalesce("total_stores", F.lit(0)).alias("total_stores")
    )


def latest_snapshot(snapshots: DataFrame, month: date) -> DataFrame:
    """The stored snapshot with the highest id of one month."""
    first_day = month.replace(day=1)
    return (
        snapshots.filter(
            (F.col("last_month_date") >= F.lit(first_day))
            & (F.col("last_month_date") < F.add_months(F.lit(first_day), 1))
        )
        .orderBy(F.col("id").desc())
        .limit(1)
        .select(
            "active_users", "free_users", "paid_users", "app_status",
            month_label("last_month_date").alias("month"),
        )
    )
