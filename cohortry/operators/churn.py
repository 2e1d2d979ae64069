"""Churn of a period: who left, from which cohort, at which stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.eligibility import SET_C, SET_D, SET_E, SET_F, SET_G, PlanFilter
from cohortry.functions.period import Period
from cohortry.functions.vocabulary import MILESTONES, VOCABULARY, EventClass, union
from cohortry.operators.accounts import cohort_accounts, cohort_of, eligible_accounts
from cohortry.operators.events import in_period
from cohortry.operators.profile import (
    Measure,
    any_of,
    ever,
    event_profile,
    holds_after,
    last,
)
from cohortry.operators.reduction import with_facts
from cohortry.operators.survival import surviving_events

Vocabulary = Mapping[str, EventClass]
ACCOUNT_ID = "store_client_id"


# ---- churn events and buckets ----------------------------------------------------------------


def churned_events(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_D,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Churn events of the period with no install strictly later in it, of eligible accounts."""
    stores = cohort_accounts(accounts, rule, period, None, account_zone)
    return surviving_events(
        activity, period, vocab["churn"], vocab["install_after_churn"], stores,
        ["event_id", "action", "page"],
    ).select("store_client_id", "store_name", "event_id", "action", "page", "created_at", "cohort")


def churn_buckets(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_D,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Churned stores with their buckets; a store can be in several.

    ``same_month``: new account, ``previous_month``: older account, ``reinstall_unistall``: older
    and re-installed in the period, ``store_closed``: closed and not re-opened at any later time.
    """
    churn = vocab["churn"].sql()
    profile = event_profile(
        activity,
        ["store_name"],
        removed=last(vocab["uninstall_action"], period, also=churn),
        removed_wide=last(vocab["uninstall_action_wide"], period, also=churn),
        closed=last(vocab["closed"], period, also=churn),
        installed=last(vocab["install_after_churn"], period),
        reopened=last(vocab["reopen"], period.onwards()),
        reinstalled=ever(vocab["reinstall"], period),
    )
    new, previous = F.col("cohort") == "new", F.col("cohort") == "previous"
    left_before = previous & holds_after("removed_wide", "installed")
    buckets = {
        "same_month": new & holds_after("removed", "installed"),
        "previous_month": left_before,
        "reinstall_unistall": left_before & F.col("reinstalled"),
        "store_closed": holds_after("closed", "installed") & holds_after("closed", "reopened"),
    }
    flags = [F.coalesce(c, F.lit(False)).alias(name) for name, c in buckets.items()]
    return (
        profile.filter("removed_wide IS NOT NULL OR closed IS NOT NULL")
        .join(cohort_accounts(accounts, rule, period, None, account_zone), "store_name")
        .select("store_client_id", "store_name", *flags)
        .filter(any_of(*(F.col(name) for name in buckets)))
    )


# ---- stores that installed and left in one month ---------------------------------------------


def _churned_store_months(
    activity: DataFrame,
    period: Period,
    vocab: Vocabulary,
    monthly: Mapping[str, Measure] | None = None,
    lifted: Mapping[str, Measure] | None = None,
) -> DataFrame:
    """One row per month of every store that installed and left in one local month of the period.

    ``uninstall_at`` is the store's last uninstall of the period; a strict fresh install falls in
    its month, and no install comes after it. ``monthly`` adds measures per (store, month) and
    ``lifted`` measures per store (times or flags, the larger value wins across months).

    A period inside one month needs one shuffle on the store. Longer ones group by (store, month)
    and lift store values by a window over those few rows; rows outside the period share one month.
    """
    monthly, lifted = monthly or {}, lifted or {}
    rows, keys = activity, ["store_name"]
    if not period.one_month:
        month = F.when(period.contains("created_at"), period.month_of("created_at"))
        rows = activity.withColumn("month", month)
        keys = ["store_name", "month"]
    profile = event_profile(
        rows,
        keys,
        uninstall_at=last(vocab["uninstall"], period),
        installed=last(vocab["install_after_churn"], period),
        fresh=ever(vocab["fresh_strict"], period),
        **monthly,
        **lifted,
    )

    if not period.one_month:
        store = Window.partitionBy("store_name")
        per_store = {
            name: F.max(name).over(store) for name in ("uninstall_at", "installed", *lifted)
        }
        per_store["fresh"] = F.max_by("fresh", "uninstall_at").over(store)
        profile = profile.withColumns(per_store)
    survives_removal = holds_after("uninstall_at", "installed") & F.col("fresh")
    selected = profile.filter(survives_removal).drop("installed", "fresh")
    if period.one_month:
        return selected.withColumn("month", period.month_of("uninstall_at"))
    return selected.filter(F.col("month").isNotNull())


def _one_row_per_store(store_months: DataFrame, period: Period) -> DataFrame:
    """The month of the last uninstall, which every selected store has."""
    return store_months.filter(F.col("month") == period.month_of("uninstall_at"))


def churned_new_installs(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_C,
    vocab: Vocabulary = VOCABULARY,
) -> DataFrame:
    """Eligible stores that freshly installed and left in one month of the period for good."""
    stores = _one_row_per_store(_churned_store_months(activity, period, vocab), period)
    kept = eligible_accounts(accounts, rule).select("store_name")
    return stores.join(kept, "store_name").select("store_name", "uninstall_at", "month")


def last_uninstall(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_F,
    cohort: str | None = None,
    uninstalls: str = "uninstall_raw",
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
    extra: Mapping[str, Measure] | None = None,
) -> DataFrame:
    """The simple churn cohort: last uninstall action per account, no test on installs.

    ``extra`` adds measures per account.
    """
    removal = last(vocab[uninstalls], period)
    profile = event_profile(activity, [ACCOUNT_ID], uninstall_at=removal, **(extra or {}))
    kept = cohort_accounts(accounts, rule, period, cohort, account_zone).drop("store_name")
    return (
        profile.filter("uninstall_at IS NOT NULL")
        .join(kept, ACCOUNT_ID)
        .withColumn("month", period.month_of("uninstall_at"))
    )


# ---- what churned stores had done ------------------------------------------------------------


def plan_at_churn(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    base: str = "new_installs",
    rule: PlanFilter | None = None,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Churned stores with their cohort and plan states; the states look at the whole log.

    The stores come from one scan of the period; of the rest of the log only their rows are aggregated.

    ``base='new_installs'`` starts from :func:`churned_new_installs`, ``'last_uninstall'`` from
    :func:`last_uninstall`. ``paid_only`` is a paid store that never was on trial.
    """
    facts = {
        "had_trial": ever(vocab["trial"]),
        "had_free": ever(vocab["free_user"]),
        "had_uninstall": ever(vocab["uninstall_only"]),
        "had_paid": ever(vocab["paid_uninstall"]),
    }
    if base == "last_uninstall":
        key = ACCOUNT_ID
        stores = last_uninstall(
            activity, accounts, period, rule or SET_F, vocab=vocab, account_zone=account_zone
        )
    else:
        key = "store_name"
        months = _churned_store_months(activity, period, vocab)
        kept = cohort_accounts(accounts, rule or SET_C, period, None, account_zone)
        stores = _one_row_per_store(months, period).join(kept.drop(ACCOUNT_ID), key)
    return with_facts(stores, activity, key, **facts).select(
        key,
        "month",
        "uninstall_at",
        "cohort",
        F.expr("had_trial AND had_uninstall AND NOT had_paid").alias("during_trial"),
        F.expr("had_uninstall AND had_free").alias("free_plan"),
        F.col("had_paid").alias("paid_plan"),
        F.expr("had_paid AND NOT had_trial").alias("paid_only"),
    )


def plan_at_churn_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """Six counts per month: trial, free and paid, each for new and older accounts."""
    new, previous = "cohort = 'new'", "cohort = 'previous'"
    return plan_at_churn(activity, accounts, period, **options).groupBy("month").agg(
        F.expr(f"count_if({new} AND during_trial) AS during_trial_monthly"),
        F.expr(f"count_if({previous} AND during_trial) AS during_trial_overall"),
        F.expr(f"count_if({new} AND free_plan) AS free_plan_monthly"),
        F.expr(f"count_if({previous} AND free_plan) AS free_plan_overall"),
        F.expr(f"count_if({new} AND paid_plan) AS paid_plan_monthly"),
        F.expr(f"count_if({previous} AND paid_only) AS paid_plan_overall"),
    )


def creation_months(
    accounts: DataFrame, period: Period, rule: PlanFilter = SET_E, account_zone: str | None = None
) -> DataFrame:
    """Eligible accounts with the local month of their creation."""
    zone = account_zone or period.zone
    return eligible_accounts(accounts, rule).select(
        ACCOUNT_ID, period.in_zone(zone).month_of("created_on").alias("month")
    )


def creation_month_events(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    rule: PlanFilter = SET_E,
    account_zone: str | None = None,
) -> DataFrame:
    """Events of the period in the account's own creation month.

    Only eligible accounts created in a month of the period meet the log, on account and month, in one
    join. Spark broadcasts them if few; otherwise adaptive execution splits an account of very many
    events over several tasks.
    """
    zone = account_zone or period.zone
    created = accounts.filter(period.whole_months().in_zone(zone).contains("created_on"))
    rows = in_period(activity, period).withColumn("month", period.month_of("created_at"))
    months = creation_months(created, period, rule, zone)
    return rows.join(months, [ACCOUNT_ID, "month"]).select(*activity.columns, "month")


def milestones_of_churned(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    base: str = "new_installs",
    rule: PlanFilter | None = None,
    vocab: Vocabulary = VOCABULARY,
    milestones: Mapping[str, EventClass] = MILESTONES,
    account_zone: str | None = None,
) -> DataFrame:
    """Product milestones per (store, month) of churned stores.

    ``uninstalled`` says whether the month's last uninstall action is strictly later than its last
    install; a month without an install never is. ``base='creation_month'`` takes accounts in their
    creation month instead of :func:`churned_new_installs`.
    """
    measures = {
        "last_uninstall": last(vocab["uninstall_bench"], period),
        "last_install": last(vocab["install_bench"], period),
        **{name: ever(cls, period) for name, cls in milestones.items()},
    }
    if base == "creation_month" or not period.one_month:
        # A month with any event is listed, also one without an event of these classes.
        measures["last_event"] = last(None, period)
    if base == "creation_month":
        key = ACCOUNT_ID
        rows = activity.withColumn("month", period.month_of("created_at"))
        kept = creation_months(accounts, period, rule or SET_E, account_zone)
        months = event_profile(rows, [key, "month"], **measures).join(kept, [key, "month"])
    else:
        key = "store_name"
        kept = eligible_accounts(accounts, rule or SET_C).select(key)
        months = _churned_store_months(activity, period, vocab, monthly=measures).join(kept, key)
    uninstalled = F.expr("coalesce(last_uninstall > last_install, false)")
    return months.select(key, "month", uninstalled.alias("uninstalled"), *milestones)


def milestones_by_month(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    milestones: Mapping[str, EventClass] = MILESTONES,
    **options,
) -> DataFrame:
    """Churned stores per month that had reached each milestone."""
    months = milestones_of_churned(activity, accounts, period, milestones=milestones, **options)
    return months.groupBy("month").agg(
        *(F.expr(f"count_if(uninstalled AND {name}) AS {name}") for name in milestones)
    )


def onboarding_stop_step(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    base: str = "new_installs",
    rule: PlanFilter | None = None,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Churned stores created in the period with the onboarding steps they took in it."""
    steps = {
        "step1": ever(vocab["onb_step1"], period),
        "step2": ever(vocab["onb_step2"], period),
        "step3": ever(vocab["onb_step3"], period),
        "completed": ever(vocab["onb_done"], period),
    }
    if base == "last_uninstall":
        key = ACCOUNT_ID
        rows = last_uninstall(
            activity, accounts, period, rule or SET_G, cohort="new", uninstalls="uninstall_only",
            vocab=vocab, account_zone=account_zone, extra=steps,
        )
    else:
        key = "store_name"
        stores = _churned_store_months(
            activity, period, vocab,
            lifted={**steps, "last_removal": last(vocab["uninstall_action"], period)},
        )
        kept = cohort_accounts(accounts, rule or SET_C, period, "new", account_zone)
        rows = (
            _one_row_per_store(stores, period)
            .filter("last_removal IS NOT NULL")
            .withColumn("month", period.month_of("last_removal"))
            .join(kept.select("store_name"), "store_name")
        )
    return rows.select(key, "month", *steps)


def onboarding_stop_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """Five counts per month. The buckets overlap: a store that only completed is in two."""
    return onboarding_stop_step(activity, accounts, period, **options).groupBy("month").agg(
        F.count_if(F.expr("NOT step1 AND NOT step2 AND NOT step3")).alias("onboarding_step_1"),
        F.count_if(F.expr("step1 AND NOT (step2 OR step3 OR completed)")).alias("onboarding_step_2"),
        F.count_if(F.expr("step2 AND NOT (step3 OR completed)")).alias("onboarding_step_3"),
        F.count_if(F.expr("step3 AND NOT completed")).alias("onboarding_step_4"),
        F.count_if("completed").alias("onboarding_completed"),
    )


def churned_unfinished(
    activity: DataFrame,
    accounts: DataFrame,
    period: Period,
    base: str = "new_installs",
    rule: PlanFilter | None = None,
    final_rule: PlanFilter = SET_G,
    vocab: Vocabulary = VOCABULARY,
    account_zone: str | None = None,
) -> DataFrame:
    """Churned stores created in the period; whether they ever finished onboarding or enabled the app.

    The base cohort uses ``rule``, and ``final_rule`` is applied on top, which drops accounts
    without a display plan again. The log is read as in :func:`plan_at_churn`.
    """
    facts = {
        "finished": ever(union(vocab["onb_step3"], vocab["onb_done"])),
        "enabled": ever(vocab["app_enabled"]),
    }
    if base == "last_uninstall":
        key = ACCOUNT_ID
        stores = last_uninstall(
            activity, accounts, period, final_rule, cohort="new", uninstalls="uninstall_only",
            vocab=vocab, account_zone=account_zone,
        )
    else:
        key = "store_name"
        months = _churned_store_months(activity, period, vocab)
        kept = eligible_accounts(eligible_accounts(accounts, rule or SET_C), final_rule).filter(
            cohort_of(period, account_zone) == "new"
        )
        stores = _one_row_per_store(months, period).join(kept.select(key), key)
    return with_facts(stores, activity, key, **facts).select(
        key,
        "month",
        "uninstall_at",
        (~F.col("finished")).alias("without_onboarding"),
        (~F.col("enabled")).alias("without_app_enabled"),
    )


def churned_unfinished_by_month(
    activity: DataFrame, accounts: DataFrame, period: Period, **options
) -> DataFrame:
    """Churned stores per month that never finished onboarding, and that never enabled the app."""
    return churned_unfinished(activity, accounts, period, **options).groupBy("month").agg(
        F.count_if("without_onboarding").alias("without_onboarding"),
        F.count_if("without_app_enabled").alias("without_app_enabled"),
    )
