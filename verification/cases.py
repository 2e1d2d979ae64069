"""The registered queries: Spark callable and independent SQL, over the sample star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.dictionary import LabelDictionary
from cohortry.functions.eligibility import (
    SET_A,
    SET_B,
    SET_C,
    SET_D,
    SET_E,
    SET_F,
    SET_G,
)
from cohortry.functions.period import Period, local_month, month_spine
from cohortry.operators import accounts as acc_ops
from cohortry.operators import churn, events, installs, month_state, subscriptions
from cohortry.plans import reports
from cohortry.sources import sample, tables
from cohortry.sources.scratch import scratch_folder
from verification import naive

# The sample has its own market segments; one of them plays an excluded plan.
BANNED = ("MACHINERY",)
A = SET_A.also(BANNED)
B = SET_B.also(BANNED)
C = SET_C.also(BANNED)
D = SET_D.also(BANNED, email_suffixes=("@internal.example",))
E = SET_E.also(BANNED, ("FURNITURE",))
F_ = SET_F.also(BANNED)
G = SET_G.also(BANNED)

JANUARY = Period.days("2024-01-01", "2024-01-30")
WEEK = Period.days("2024-01-08", "2024-01-14")
TO_DATE = Period.days("2024-01-20", "2024-01-31")
WINDOW = Period.days("2024-01-24", "2024-01-29")
UNTIL = Period.until("2024-01-20", datetime(2024, 1, 30, 17, 45))
TO_NOW = Period.until("2024-01-20")
HALF_YEAR = Period.days("1996-03-01", "1996-08-31")
YEARS = Period.through("1999-12-31")
SPAN = Period.days("1995-02-01", "2001-07-31")
ALL_ORDERS = Period.through("2001-12-31")
LATE = Period.month("2001-01")
JUNE = Period.month("1997-06")
RULE_MONTH = date(1997, 3, 1)

# The sample's labels are input, not what is checked: both sides share the lists.
EVENT_ACTION = sample.label_sql(sample.EVENT_LABELS, "event_type", "event_id", "user_id", "[{}]", 1)
ORDER_ACTION = sample.label_sql(sample.ORDER_LABELS, "o_orderpriority", "o_orderkey", "o_custkey", "[{}]", 1)
_ACCOUNT = """
account AS (
    SELECT c_custkey AS store_client_id, c_name AS store_name, c_mktsegment AS shop_plan,
           CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS plan_display_name,
           {created_on} AS created_on,
           CAST(c_custkey % 3 AS VARCHAR) AS charge_approve,
           CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE '1' END AS status,
           CASE WHEN c_custkey % 13 = 0 THEN NULL
                WHEN c_custkey % 7 = 0 THEN 'u' || c_custkey || '@internal.example'
                ELSE 'u' || c_custkey || '@shop.example' END AS email
    FROM customer
)"""

SAMPLE_E = f"""WITH activity AS (
    SELECT event_id, user_id AS store_client_id, c_name AS store_name, {EVENT_ACTION} AS action,
           {sample.EVENT_PAGE} AS page, ts AS created_at
    FROM events JOIN customer ON user_id = c_custkey
),""" + _ACCOUNT.format(created_on="""TIMESTAMP '2023-11-25' + INTERVAL 1 DAY * (c_custkey * 7 % 60)
                + INTERVAL 1 HOUR * (c_custkey % 24)""")

SAMPLE_O = f"""WITH activity AS (
    SELECT o_orderkey AS event_id, {sample.ORDER_ID} AS store_client_id, c_name AS store_name,
           {ORDER_ACTION} AS action, {sample.ORDER_PAGE} AS page,
           CASE WHEN o_custkey % 3 = 0
                THEN TIMESTAMP '1995-01-01' + INTERVAL 1 MONTH * (o_custkey % 79)
                     + INTERVAL 1 DAY * (day(o_orderdate) - 1) + INTERVAL 6 HOUR * (o_orderkey % 4)
                ELSE o_orderdate END AS created_at
    FROM orders JOIN customer ON o_custkey = c_custkey
),""" + _ACCOUNT.format(created_on="""CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '1994-05-01'
                WHEN c_custkey % 3 = 0
                THEN TIMESTAMP '1995-01-01' + INTERVAL 1 MONTH * (c_custkey % 79) - INTERVAL 40 DAY * (c_custkey % 2)
                ELSE TIMESTAMP '1994-07-01' + INTERVAL 1 DAY * (c_custkey * 37 % 1400) END""") + """, snapshot AS (
    SELECT row_number() OVER (ORDER BY m, o_orderstatus) AS id, count(DISTINCT o_custkey) AS active_users,
           count(DISTINCT o_custkey) - count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT')
               AS free_users,
           count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT') AS paid_users,
           o_orderstatus AS app_status, m AS last_month_date
    FROM (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) GROUP BY m, o_orderstatus
)"""


@dataclass(frozen=True)
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


def _on_events(build: Callable[..., DataFrame], sql: str) -> Case:
    """A query on the one-month log: ``build(activity, accounts)``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(sample.activity_e(spark, sf_dir), sample.account_e(spark, sf_dir))

    return Case(run, f"{SAMPLE_E} SELECT * FROM ({sql})")


def _on_orders(build: Callable[..., DataFrame], sql: str) -> Case:
    """A query on the 80-month log: ``build(activity, accounts)``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(sample.activity_o(spark, sf_dir), sample.account_o(spark, sf_dir))

    return Case(run, f"{SAMPLE_O} SELECT * FROM ({sql})")


def _spine_counts(activity: DataFrame) -> DataFrame:
    """Re-installs per month over the log's whole span, zero-filled."""
    month = local_month("created_at")
    bounds = activity.agg(F.min(month).alias("first"), F.max(month).alias("last"))
    again = events.classify_events(activity, only=["reinstall_wide"])
    counts = again.groupBy(month.alias("month")).agg(
        F.count_if("is_reinstall_wide").alias("reinstalls")
    )
    return month_spine(bounds).join(counts, "month", "left").select(
        "month", F.coalesce("reinstalls", F.lit(0)).alias("reinstalls")
    )


def _labelled(sql: str) -> str:
    """A month column as 'YYYY-MM'."""
    return f"SELECT * REPLACE (strftime(month, '%Y-%m') AS month) FROM ({sql})"


def _snapshot_case() -> Case:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.snapshot(sample.snapshot_o(spark, sf_dir), RULE_MONTH)

    return Case(run, f"{SAMPLE_O} SELECT * FROM ({naive.latest_snapshot('1997-03')})")


def _on_stored(build: Callable[..., DataFrame], sql: str) -> Case:
    """A query on the one-month log stored by day and its stored accounts, opened by the readers."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_folder(spark)
        tables.write_activity(sample.activity_e(spark, sf_dir), f"{folder}/activity")
        sample.account_e(spark, sf_dir).write.parquet(f"{folder}/account")
        return build(
            tables.read_activity(spark, f"{folder}/activity", "event_date"),
            tables.read_accounts(spark, f"{folder}/account"))

    return Case(run, f"{SAMPLE_E} SELECT * FROM ({sql})")


def _snapshot_scan_case() -> Case:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_folder(spark)}/snapshot"
        sample.snapshot_o(spark, sf_dir).write.parquet(path)
        return reports.snapshot(tables.read_snapshots(spark, path), RULE_MONTH)

    return Case(run, f"{SAMPLE_O} SELECT * FROM ({naive.latest_snapshot('1997-03')})")


def _violations_case() -> Case:
    """The key check on accounts whose keys are made to clash."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_folder(spark)}/account"
        sample.account_e(spark, sf_dir).withColumns({
            "store_client_id": F.expr("if(store_client_id % 50 = 0, store_client_id % 100, store_client_id)"),
            "store_name": F.expr(
                "CASE WHEN store_client_id % 61 = 0 THEN NULL WHEN store_client_id % 40 = 1 THEN 'twin' "
                "ELSE store_name END")}).write.parquet(path)
        return tables.account_key_violations(tables.read_accounts(spark, path, check=False))

    clashing = """clashing AS (
        SELECT CASE WHEN store_client_id % 50 = 0 THEN store_client_id % 100 ELSE store_client_id END AS store_client_id,
               CASE WHEN store_client_id % 61 = 0 THEN NULL WHEN store_client_id % 40 = 1 THEN 'twin'
                    ELSE store_name END AS store_name FROM account)"""
    return Case(run, f"{SAMPLE_E}, {clashing} SELECT * FROM ({naive.key_violations()})")


def cases() -> dict[str, Case]:
    on_e, on_o = _on_events, _on_orders
    found = {
        # rows and accounts
        "classify_events": on_e(
            lambda a, c: events.classify_events(a).drop(*a.columns[1:]), naive.classify_events()),
        "install_type": on_o(
            lambda a, c: events.in_period(a, HALF_YEAR)
            .filter(F.lower("action").isin(
                "fresh install", "fresh installs", "fresh_install",
                "reinstall", "re-installs", "re installs", "re_install"))
            .select("event_id", events.install_type().alias("install_type")),
            naive.install_types(HALF_YEAR)),
        "period_slice": on_e(
            lambda a, c: events.in_period(a, WEEK).select("event_id", "store_name", "created_at"),
            naive.period_slice(WEEK)),
        "events_per_month": on_o(
            lambda a, c: events.events_per_month(a), naive.events_per_month(ALL_ORDERS)),
        "month_spine": on_o(lambda a, c: _spine_counts(a), naive.month_spine(ALL_ORDERS)),
        "account_cohort": on_e(
            lambda a, c: acc_ops.cohort_accounts(c, A, WEEK), naive.account_cohort(WEEK, A)),
        # installs
        "surviving_installs": on_e(
            lambda a, c: installs.surviving_installs(a, c, JANUARY, rule=A),
            naive.surviving_installs(JANUARY, A)),
        "surviving_installs_week": on_e(
            lambda a, c: installs.surviving_installs(a, c, WEEK, rule=A, cohort="previous"),
            naive.surviving_installs(WEEK, A, "previous")),
        "surviving_reinstalls": on_e(
            lambda a, c: installs.surviving_reinstalls(a, c, JANUARY, rule=A),
            naive.surviving_reinstalls(JANUARY, A)),
        "reopened_stores": on_e(
            lambda a, c: installs.reopened_stores(a, c, JANUARY, rule=A),
            naive.reopened_stores(JANUARY, A)),
        "install_status": on_e(
            lambda a, c: installs.install_status(a, c, JANUARY, rule=A),
            naive.install_status(JANUARY, A)),
        "install_status_by_month": on_e(
            lambda a, c: installs.status_by_month(a, c, JANUARY, rule=A),
            naive.status_by_month(JANUARY, A)),
        "install_status_by_month_outer": on_o(
            lambda a, c: installs.status_by_month(a, c, HALF_YEAR, how="outer", rule=A),
            naive.status_by_month(HALF_YEAR, A, "outer")),
        "fresh_installs_by_month": on_e(
            lambda a, c: installs.fresh_count_by_month(a, c, JANUARY, rule=A),
            naive.fresh_count_by_month(JANUARY, A)),
        "fresh_installs_by_month_span": on_o(
            lambda a, c: installs.fresh_count_by_month(a, c, HALF_YEAR, rule=A),
            naive.fresh_count_by_month(HALF_YEAR, A)),
        "installs_to_date": on_e(
            lambda a, c: installs.installs_to_date(
                a, c, TO_DATE, WINDOW, cohort="previous", installs="reinstall", rule=A),
            naive.installs_to_date(TO_DATE, WINDOW, A, "previous", "reinstall")),
        "new_not_reinstalled": on_e(
            lambda a, c: installs.new_not_reinstalled(a, c, JANUARY, rule=A),
            naive.new_not_reinstalled(JANUARY, A)),
        "install_multiplicity": on_e(
            lambda a, c: installs.install_multiplicity(a, c, JANUARY, rule=A),
            naive.install_multiplicity(JANUARY, A)),
        "onboarding_new_cohort": on_e(
            lambda a, c: installs.onboarding_of_new(a, c, JANUARY, rule=A),
            naive.onboarding_of_new(JANUARY, A)),
        "free_plan_stores": on_e(
            lambda a, c: installs.free_plan_stores(a, c, JANUARY, rule=A),
            naive.free_plan_stores(JANUARY, A)),
        "paid_stores": on_e(
            lambda a, c: installs.paid_stores(a, c, JANUARY, rule=A),
            naive.paid_stores(JANUARY, A)),
        "conversion_summary": on_e(
            lambda a, c: reports.conversion_summary(a, c, JANUARY, rule=A),
            naive.conversion_summary(JANUARY, A)),
        # month state
        "installed_at_month_end": on_o(
            lambda a, c: month_state.installed_at_month_end(a, ALL_ORDERS),
            naive.installed_at_month_end(ALL_ORDERS)),
        "installed_at_month_end_older": on_o(
            lambda a, c: month_state.installed_at_month_end(a, YEARS, c, JUNE),
            naive.installed_at_month_end(YEARS, JUNE)),
        "onboarding_completed_by_month": on_o(
            lambda a, c: month_state.onboarding_by_month(
                a, c, YEARS, "completed", before=JUNE, rule=B),
            naive.onboarding_by_month(YEARS, B, "completed", JUNE)),
        "onboarding_pending_by_month": on_o(
            lambda a, c: month_state.onboarding_by_month(a, c, YEARS, "pending", before=JUNE, rule=B),
            naive.onboarding_by_month(YEARS, B, "pending", JUNE)),
        "converted_after_install": on_o(
            lambda a, c: month_state.converted_after_install(a, c, HALF_YEAR, rule=B),
            naive.converted_after_install(HALF_YEAR, B)),
        "converted_after_install_older": on_o(
            lambda a, c: month_state.converted_after_install(a, c, JUNE, scope="before", rule=B),
            naive.converted_after_install(JUNE, B, "before")),
        "free_without_upgrade": on_o(
            lambda a, c: month_state.free_without_upgrade(a, c, HALF_YEAR, rule=B),
            naive.free_without_upgrade(HALF_YEAR, B)),
        "free_without_upgrade_older": on_o(
            lambda a, c: month_state.free_without_upgrade(a, c, JUNE, scope="before", rule=B),
            naive.free_without_upgrade(JUNE, B, "before")),
        # subscriptions
        "active_accounts": on_o(
            lambda a, c: subscriptions.active_accounts(a, c, LATE, rule=B),
            naive.active_accounts(LATE, B)),
        "active_by_plan": on_o(
            lambda a, c: reports.active_by_plan(a, c, LATE, rule=B), naive.active_by_plan(LATE, B)),
        "first_paid": on_e(
            lambda a, c: subscriptions.first_paid(a, c, JANUARY, rule=B),
            naive.first_paid(JANUARY, B)),
        "first_paid_by_month": on_e(
            lambda a, c: reports.first_paid_by_month(a, c, JANUARY, rule=B),
            naive.first_paid_by_month(JANUARY, B)),
        "first_paid_by_month_span": on_o(
            lambda a, c: reports.first_paid_by_month(a, c, HALF_YEAR, rule=B),
            naive.first_paid_by_month(HALF_YEAR, B)),
        "latest_snapshot": _snapshot_case(),
        # churn
        "churned_events": on_e(
            lambda a, c: churn.churned_events(a, c, JANUARY, rule=D),
            naive.churned_events(JANUARY, D)),
        "churn_bucket_stores": on_e(
            lambda a, c: churn.churn_buckets(a, c, JANUARY, rule=D),
            naive.churn_buckets(JANUARY, D)),
        "churn_buckets": on_e(
            lambda a, c: reports.churn_buckets(a, c, WEEK, rule=D),
            naive.churn_bucket_totals(WEEK, D)),
        "churned_new_installs": on_e(
            lambda a, c: churn.churned_new_installs(a, c, JANUARY, rule=C),
            naive.churned_new_installs(JANUARY, C)),
        "churned_new_installs_span": on_o(
            lambda a, c: churn.churned_new_installs(a, c, SPAN, rule=C),
            naive.churned_new_installs(SPAN, C)),
        "last_uninstall": on_e(
            lambda a, c: churn.last_uninstall(a, c, JANUARY, rule=F_).drop("cohort"),
            naive.last_uninstall(JANUARY, F_)),
        "creation_month_events": on_e(
            lambda a, c: churn.creation_month_events(a, c, JANUARY, rule=E),
            naive.creation_month_events(JANUARY, E)),
        "plan_at_churn": on_e(
            lambda a, c: reports.plan_at_churn(a, c, JANUARY, rule=C),
            naive.plan_at_churn(JANUARY, C)),
        "plan_at_churn_span": on_o(
            lambda a, c: reports.plan_at_churn(a, c, SPAN, rule=C),
            naive.plan_at_churn(SPAN, C)),
        "plan_at_churn_simple": on_e(
            lambda a, c: reports.plan_at_churn(a, c, WEEK, base="last_uninstall", rule=F_),
            naive.plan_at_churn(WEEK, F_, "last_uninstall")),
        "milestones_of_churned": on_e(
            lambda a, c: reports.milestones_of_churned(a, c, JANUARY, rule=C),
            naive.milestones_of_churned(JANUARY, C)),
        "milestones_of_churned_span": on_o(
            lambda a, c: reports.milestones_of_churned(a, c, SPAN, rule=C),
            naive.milestones_of_churned(SPAN, C)),
        "milestones_creation_month": on_e(
            lambda a, c: reports.milestones_of_churned(
                a, c, JANUARY, base="creation_month", rule=E),
            naive.milestones_of_churned(JANUARY, E, "creation_month")),
        "onboarding_stop_step": on_e(
            lambda a, c: reports.onboarding_stop_step(a, c, JANUARY, rule=C),
            naive.onboarding_stop_step(JANUARY, C)),
        "onboarding_stop_step_span": on_o(
            lambda a, c: reports.onboarding_stop_step(a, c, SPAN, rule=C),
            naive.onboarding_stop_step(SPAN, C)),
        "onboarding_stop_step_simple": on_e(
            lambda a, c: reports.onboarding_stop_step(
                a, c, JANUARY, base="last_uninstall", rule=G),
            naive.onboarding_stop_step(JANUARY, G, "last_uninstall")),
        "churned_unfinished": on_e(
            lambda a, c: reports.unfinished_churn(a, c, JANUARY, rule=C, final_rule=G),
            naive.churned_unfinished(JANUARY, C, G)),
        "churned_unfinished_span": on_o(
            lambda a, c: reports.unfinished_churn(a, c, SPAN, rule=C, final_rule=G),
            naive.churned_unfinished(SPAN, C, G)),
        "churned_unfinished_simple": on_e(
            lambda a, c: reports.unfinished_churn(
                a, c, JANUARY, base="last_uninstall", final_rule=G),
            naive.churned_unfinished(JANUARY, C, G, "last_uninstall")),
        # readers, the stored log and the label dictionary
        "scan_stored_log": _on_stored(
            lambda a, c: events.in_period(a, WEEK).select("event_id", "store_name", "created_at"),
            naive.period_slice(WEEK)),
        "scan_stored_accounts": _on_stored(
            lambda a, c: acc_ops.cohort_accounts(c, A, WEEK), naive.account_cohort(WEEK, A)),
        "scan_stored_snapshots": _snapshot_scan_case(),
        "stored_surviving_installs": _on_stored(
            lambda a, c: installs.surviving_installs(a, c, JANUARY, rule=A),
            naive.surviving_installs(JANUARY, A)),
        "account_key_violations": _violations_case(),
        "classify_by_dictionary": on_e(
            lambda a, c: LabelDictionary.of(a).classify(a).drop(*a.columns[1:]), naive.classify_events()),
        "stored_churned_events_by_dictionary": _on_stored(
            lambda a, c: churn.churned_events(a, c, JANUARY, rule=D, vocab=LabelDictionary.of(a).vocabulary()),
            naive.churned_events(JANUARY, D)),
        "installs_to_now": on_e(
            lambda a, c: installs.installs_to_date(
                a, c, TO_NOW, WINDOW, cohort="previous", installs="reinstall", rule=A),
            naive.installs_to_date(TO_NOW, WINDOW, A, "previous", "reinstall")),
        # finished reports not covered above
        "report_install_status_rows": on_e(
            lambda a, c: reports.install_status_rows(a, c, JANUARY, "reinstall", rule=A),
            f"SELECT store_name, created_at FROM ({naive.surviving_reinstalls(JANUARY, A)})"),
        "report_install_status_fresh": on_e(
            lambda a, c: reports.install_status_rows(a, c, JANUARY, "fresh", rule=A),
            f"SELECT store_name, created_at FROM ({naive.surviving_installs(JANUARY, A)})"),
        "report_install_status_reopen": on_e(
            lambda a, c: reports.install_status_rows(a, c, JANUARY, "reopen", rule=A),
            f"SELECT store_name, created_at FROM ({naive.reopened_stores(JANUARY, A)})"),
        "installs_until": on_e(
            lambda a, c: installs.installs_to_date(
                a, c, UNTIL, WINDOW, cohort="previous", installs="reinstall", rule=A),
            naive.installs_to_date(UNTIL, WINDOW, A, "previous", "reinstall")),
        "report_churn_bucket_closed": on_e(
            lambda a, c: reports.churn_bucket_rows(a, c, JANUARY, "store_closed", rule=D),
            f"SELECT store_client_id, store_name FROM ({naive.churn_buckets(JANUARY, D)}) "
            "WHERE store_closed"),
        "report_churn_bucket_reinstalled": on_e(
            lambda a, c: reports.churn_bucket_rows(a, c, JANUARY, "reinstall_unistall", rule=D),
            f"SELECT store_client_id, store_name FROM ({naive.churn_buckets(JANUARY, D)}) "
            "WHERE reinstall_unistall"),
        "report_onboarding_of_new": on_e(
            lambda a, c: reports.onboarding_of_new(a, c, JANUARY, rule=A),
            naive.onboarding_of_new_totals(JANUARY, A)),
        "report_onboarding_completed": on_o(
            lambda a, c: reports.onboarding_completed_by_month(a, c, HALF_YEAR, rule=B),
            _labelled(naive.onboarding_by_month(HALF_YEAR, B, "completed"))),
        "report_onboarding_pending": on_o(
            lambda a, c: reports.onboarding_pending_by_month(a, c, HALF_YEAR, rule=B),
            _labelled(naive.onboarding_by_month(HALF_YEAR, B, "pending"))),
        "report_churn_bucket_rows": on_e(
            lambda a, c: reports.churn_bucket_rows(a, c, JANUARY, "previous_month", rule=D),
            f"SELECT store_client_id, store_name FROM ({naive.churn_buckets(JANUARY, D)}) "
            "WHERE previous_month"),
        "report_paid_installs": on_o(
            lambda a, c: reports.paid_installs(a, c, HALF_YEAR, rule=B),
            naive.paid_installs(HALF_YEAR, B)),
        "report_free_installs": on_o(
            lambda a, c: reports.free_installs(a, c, HALF_YEAR, rule=B),
            naive.free_installs(HALF_YEAR, B)),
        "report_free_installs_by_type": on_o(
            lambda a, c: reports.free_installs(a, c, HALF_YEAR, by_type=True, rule=B),
            naive.free_installs(HALF_YEAR, B, by_type=True)),
        "report_fresh_by_month": on_o(
            lambda a, c: reports.fresh_by_month(a, c, HALF_YEAR, rule=A),
            _labelled(naive.fresh_count_by_month(HALF_YEAR, A))),
        "report_installs_to_date": on_e(
            lambda a, c: reports.installs_to_date(a, c, TO_DATE, WINDOW, cohort="previous", rule=A),
            naive.installs_to_date(TO_DATE, WINDOW, A, "previous")),
        "report_status_by_month": on_e(
            lambda a, c: reports.status_by_month(a, c, JANUARY, rule=A),
            _labelled(naive.status_by_month(JANUARY, A))),
        "report_install_multiplicity": on_e(
            lambda a, c: reports.install_multiplicity(a, c, JANUARY, rule=A),
            naive.multiplicity_totals(JANUARY, A)),
    }
    for name, rule in {"a": A, "b": B, "c": C, "d": D, "e": E, "f": F_, "g": G}.items():
        found[f"eligible_accounts_{name}"] = on_e(
            lambda a, c, rule=rule: acc_ops.eligible_accounts(c, rule).select(
                "store_client_id", "store_name"),
            naive.eligible_accounts(rule))
    return found
