"""The finished reports: operators rolled up, month labels formatted, rows sorted.

Every report takes the tables and a :class:`Period`; keyword options go through to the operators
(exclusion rule, vocabulary, account zone, cohort base). Each returns a lazy DataFrame.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.period import Period, month_label
from cohortry.operators import churn, installs, month_state, subscriptions


def _by_month(frame: DataFrame) -> DataFrame:
    """Months sorted and shown as 'YYYY-MM'."""
    values = [c for c in frame.columns if c != "month"]
    return frame.orderBy("month").select(month_label("month").alias("month"), *values)


def count_rows(frame: DataFrame, name: str) -> DataFrame:
    """One row with the number of rows of a drill-down."""
    return frame.agg(F.count("*").alias(name))


# ---- installs ----------------------------------------------------------------------------------


def conversion_summary(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """New installs that are on the free plan, that paid, and all of them."""
    outcomes = installs.new_install_outcomes(activity, accounts, period, **options)
    return outcomes.agg(
        F.count_if("on_free_plan").alias("free_plan_users"),
        F.count_if("charge_approved").alias("charge_approved"),
        F.count("*").alias("total_fresh_installs"),
    )


def active_by_plan(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """R2: active accounts from before the period, free and paid."""
    return subscriptions.active_by_plan(activity, accounts, period, **options)


def first_paid_by_month(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """First payments per month, zero-filled."""
    return _by_month(subscriptions.first_paid_by_month(activity, accounts, period, **options))


def install_status_rows(
    activity: DataFrame, accounts: DataFrame, period: Period, status: str = "reinstall", **options
):
    """Stores of one install status: 'fresh', 'reinstall' or 'reopen'."""
    operator = {
        "fresh": installs.surviving_installs,
        "reinstall": installs.surviving_reinstalls,
        "reopen": installs.reopened_stores,
    }[status]
    return operator(activity, accounts, period, **options).select("store_name", "created_at")


def onboarding_of_new(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """New installs, how many owe onboarding and how many completed it."""
    return installs.onboarding_of_new(activity, accounts, period, **options).agg(
        F.count("*").alias("fresh_installs"),
        F.count_if(~F.col("onboarded")).alias("onboarding_pending"),
        F.count_if("onboarded").alias("onboarding_completed"),
    )


def snapshot(snapshots: DataFrame, month: date) -> DataFrame:
    """The latest stored totals of a month."""
    return subscriptions.latest_snapshot(snapshots, month)


def onboarding_completed_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
):
    """Stores installed at month end that completed onboarding in the month."""
    return _by_month(
        month_state.onboarding_by_month(activity, accounts, period, "completed", **options)
    )


def onboarding_pending_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
):
    """Stores installed at month end that owe onboarding."""
    return _by_month(
        month_state.onboarding_by_month(activity, accounts, period, "pending", **options)
    )


# ---- churn -------------------------------------------------------------------------------------


def plan_at_churn(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Churned stores by plan state and cohort."""
    return _by_month(churn.plan_at_churn_by_month(activity, accounts, period, **options))


def milestones_of_churned(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Milestones churned stores had reached."""
    return _by_month(churn.milestones_by_month(activity, accounts, period, **options))


def onboarding_stop_step(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """The onboarding step at which churned stores stopped."""
    return _by_month(churn.onboarding_stop_by_month(activity, accounts, period, **options))


def churn_buckets(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Churned stores by bucket, one row."""
    buckets = ["same_month", "previous_month", "reinstall_unistall", "store_closed"]
    return churn.churn_buckets(activity, accounts, period, **options).agg(
        *(F.count_if(name).alias(name) for name in buckets)
    )


def churn_bucket_rows(
    activity: DataFrame, accounts: DataFrame, period: Period, bucket: str = "same_month", **options
):
    """R12, drill-down: the stores of one bucket."""
    stores = churn.churn_buckets(activity, accounts, period, **options)
    return stores.filter(F.col(bucket)).select("store_client_id", "store_name")


def unfinished_churn(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Churned stores that never finished onboarding, or never enabled the app."""
    return _by_month(churn.churned_unfinished_by_month(activity, accounts, period, **options))


# ---- conversion and counts ---------------------------------------------------------------------


def paid_installs(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Installs that later upgraded."""
    converted = month_state.converted_after_install(activity, accounts, period, **options)
    return count_rows(converted, "paid_install_count")


def free_installs(
    activity: DataFrame, accounts: DataFrame, period: Period, by_type: bool = False, **options
):
    """Installs that stayed free; one number, or per month split by install type."""
    months = month_state.free_without_upgrade(activity, accounts, period, **options)
    if by_type:
        return _by_month(months.groupBy("month").agg(
            F.count_if("is_fresh").alias("fresh_install_with_trial"),
            F.count_if("is_reinstall").alias("reinstall_with_trial"),
        ))
    return count_rows(months.select("store_client_id").distinct(), "free_install_count")


def fresh_by_month(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Distinct new stores per month of a surviving install."""
    return _by_month(installs.fresh_count_by_month(activity, accounts, period, **options))


def installs_to_date(
    activity: DataFrame, accounts: DataFrame, period: Period, window: Period, **options
):
    """Stores with a surviving install in a window of an open-ended period."""
    return installs.installs_to_date(activity, accounts, period, window, **options)


def new_not_reinstalled(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """New stores without a surviving re-install."""
    return installs.new_not_reinstalled(activity, accounts, period, **options)


def status_by_month(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Fresh, re-installed and re-opened stores per month."""
    return _by_month(installs.status_by_month(activity, accounts, period, **options))


def install_multiplicity(activity: DataFrame, accounts: DataFrame, period: Period, **options):
    """Stores with one and with several surviving installs."""
    stores = installs.install_multiplicity(activity, accounts, period, **options)
    return stores.agg(
        F.count_if(F.col("install_count") == 1).alias("single"),
        F.count_if(F.col("install_count") > 1).alias("multiple"),
    )
