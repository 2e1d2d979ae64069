"""Account-side operators: eligibility and cohorts by account creation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.eligibility import PlanFilter
from cohortry.functions.period import Period

def eligible_accounts(accounts: DataFrame, rule: PlanFilter) -> DataFrame:
    return accounts.filter(rule.accepts())


def excluded_accounts(accounts: DataFrame, rule: PlanFilter) -> DataFrame:
    """Accounts known to be in an excluded plan; for anti-joins."""
    return accounts.filter(rule.excluded_plan())


def cohort_of(period: Period, account_zone: str | None = None) -> Column:
    """'new' for accounts created in the period, 'previous' before it, NULL after it.

    ``account_zone`` reads the period bounds in another zone ('+00:00' takes creation times as they
    are); by default they are local, as for events.
    """
    bounds = period.in_zone(account_zone)
    return F.expr(
        f"CASE WHEN {bounds.before_sql('created_on')} THEN 'previous'"
        f" WHEN {bounds.so_far().sql('created_on')} THEN 'new' END"
    )


def cohort_accounts(
    accounts: DataFrame,
    rule: PlanFilter,
    period: Period,
    cohort: str | None = None,
    account_zone: str | None = None,
) -> DataFrame:
    """Keys and cohort of the eligible accounts, optionally of one cohort only."""
    kept = eligible_accounts(accounts, rule)
    bounds = period.in_zone(account_zone)
    if cohort == "new":
        kept = kept.filter(bounds.contains("created_on"))
    elif cohort == "previous":
        kept = kept.filter(bounds.before("created_on"))
    label = cohort_of(period, account_zone) if cohort is None else F.lit(cohort)
    return kept.select("store_client_id", "store_name", label.alias("cohort"))
