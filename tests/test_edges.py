"""Hand-made rows for ties, bounds, NULLs and order rules."""

import re
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from cohortry.functions.eligibility import SET_A, SET_C, SET_D
from cohortry.functions.period import Period, period_months
from cohortry.operators import accounts as acc_ops
from cohortry.operators import churn, events, installs, month_state, subscriptions
from cohortry.plans import reports
from cohortry.sources.tables import checked_accounts
from tests.logs import NEW, OLD, Log, account, event

FEBRUARY = Period.month("2026-02")
T = datetime(2026, 2, 10, 12)
LATER = T + timedelta(hours=1)
START = datetime(2026, 1, 31, 18, 30)
END = datetime(2026, 2, 28, 18, 30)
TICK = timedelta(microseconds=1)


@pytest.fixture
def log(spark, tmp_path):
    def make(events, accounts=None):
        stores = sorted({e["store_client_id"] for e in events})
        made = {a["store_client_id"]: a for a in accounts or []}
        return Log(spark, tmp_path, events, [made.get(s, account(s)) for s in stores])

    return make


def stores(frame) -> list[int]:
    key = "store_client_id" if "store_client_id" in frame.columns else "store_name"
    return sorted(int(str(r[key]).removeprefix("shop-")) for r in frame.collect())


def test_churn_at_the_install_instant_does_not_count(log):
    one = log([event(1, "fresh_install", T), event(1, "uninstall", T),
               event(2, "fresh_install", T), event(2, "uninstall", LATER)])
    assert stores(installs.surviving_installs(one.activity, one.accounts, FEBRUARY)) == [1]


def test_charge_at_the_free_instant_ends_the_free_plan(log):
    one = log([event(s, "fresh_install", T) for s in (1, 2)] + [
        event(1, "Free Plan", LATER), event(1, "Charge Approved", LATER),
        event(2, "Free Plan", LATER), event(2, "Charge Approved", T + TICK)])
    assert stores(installs.free_plan_stores(one.activity, one.accounts, FEBRUARY)) == [2]


def test_charge_at_the_install_instant_is_not_paid(log):
    one = log([event(1, "fresh_install", T), event(1, "Charge Approved", T),
               event(2, "fresh_install", T), event(2, "Charge Approved", T + TICK)])
    assert stores(installs.paid_stores(one.activity, one.accounts, FEBRUARY)) == [2]


def test_period_is_half_open_in_local_time(log):
    one = log([event(1, "fresh_install", START - TICK), event(2, "fresh_install", START),
               event(3, "fresh_install", END - TICK), event(4, "fresh_install", END)])
    assert stores(installs.surviving_installs(one.activity, one.accounts, FEBRUARY)) == [2, 3]


def test_cohort_bounds_are_local_unless_told_otherwise(log):
    one = log([event(s, "fresh_install", T) for s in (1, 2)],
              [account(1, created_on=START), account(2, created_on=START - TICK)])
    assert stores(installs.surviving_installs(one.activity, one.accounts, FEBRUARY)) == [1]
    plain = acc_ops.cohort_accounts(one.accounts, SET_A, FEBRUARY, "new", account_zone="+00:00")
    assert stores(plain) == []


def test_page_alone_is_churn(log):
    one = log([event(1, "fresh_install", T), event(1, "other", LATER, page="uninstall"),
               event(2, "fresh_install", T), event(2, "other", LATER, page=None)])
    assert stores(installs.surviving_installs(one.activity, one.accounts, FEBRUARY)) == [2]


def test_null_plans_per_exclusion_set(log):
    one = log([event(s, "fresh_install", T) for s in (1, 2, 3, 4)], [
        account(1, shop_plan=None), account(2, plan_display_name=None),
        account(3, email=None), account(4)])
    suffix = SET_D.also(email_suffixes=["@internal.example"])
    assert stores(acc_ops.eligible_accounts(one.accounts, SET_A)) == [3, 4]
    assert stores(acc_ops.eligible_accounts(one.accounts, SET_C)) == [2, 3, 4]
    assert stores(acc_ops.eligible_accounts(one.accounts, suffix)) == [2, 4]


def test_closed_bucket_needs_no_later_reopening_ever(log):
    one = log([event(1, "Store closed", T), event(1, "store re-opened", END + timedelta(days=90)),
               event(2, "Store closed", T), event(2, "reopen", T),
               event(3, "reopen", T), event(3, "Store closed", LATER)])
    closed = reports.churn_bucket_rows(one.activity, one.accounts, FEBRUARY, "store_closed")
    assert stores(closed) == [2, 3]


def test_closing_does_not_move_the_last_uninstall(log):
    one = log([event(1, "fresh_install", T), event(1, "uninstall", LATER),
               event(1, "Store closed", LATER + TICK),
               event(2, "fresh_install", T), event(2, "Store closed", LATER)])
    found = churn.churned_new_installs(one.activity, one.accounts, FEBRUARY).collect()
    assert [(r.store_name, r.uninstall_at) for r in found] == [("shop-1", LATER)]


def test_reopening_tied_with_a_close_is_not_open(log):
    one = log([event(1, "reopen", T), event(1, "Store closed", T),
               event(2, "Store closed", T), event(2, "reopen", LATER),
               event(3, "reopen", T), event(3, "uninstall", LATER), event(3, "other", LATER + TICK)],
              [account(s, created_on=OLD) for s in (1, 2, 3)])
    assert stores(installs.reopened_stores(one.activity, one.accounts, FEBRUARY)) == [2, 3]


def test_lifecycle_tie_leaves_the_store_installed(log):
    one = log([event(1, "fresh_install", T), event(1, "uninstall", T),
               event(2, "fresh_install", T), event(2, "uninstall", LATER)])
    assert stores(month_state.installed_at_month_end(one.activity, FEBRUARY)) == [1]


def test_only_completed_is_in_two_stop_buckets(log):
    one = log([event(1, "fresh_install", T), event(1, "Onboarding—completed", T),
               event(1, "uninstall", LATER)])
    row = reports.onboarding_stop_step(one.activity, one.accounts, FEBRUARY).first()
    assert row.asDict() == {
        "month": "2026-02", "onboarding_step_1": 1, "onboarding_step_2": 0,
        "onboarding_step_3": 0, "onboarding_step_4": 0, "onboarding_completed": 1}


def test_spine_fills_months_without_a_payment(log):
    one = log([event(1, "pricing_plan_type-4", T)], [account(1, created_on=OLD)])
    spring = Period.days("2026-01-01", "2026-03-31")
    rows = reports.first_paid_by_month(one.activity, one.accounts, spring).collect()
    assert [tuple(r) for r in rows] == [("2026-01", 0), ("2026-02", 1), ("2026-03", 0)]


def test_month_missing_in_one_count(log):
    one = log([event(1, "fresh_install", T)])
    inner = reports.status_by_month(one.activity, one.accounts, FEBRUARY)
    outer = reports.status_by_month(one.activity, one.accounts, FEBRUARY, how="outer")
    assert inner.count() == 0
    assert [tuple(r) for r in outer.collect()] == [("2026-02", 1, 0, 0)]


def test_latest_of_two_snapshots(spark):
    snapshots = spark.createDataFrame(
        [(1, 5, 3, 2, "a", date(2026, 3, 1)), (2, 6, 4, 2, "b", date(2026, 3, 31)),
         (3, 7, 4, 3, "c", date(2026, 4, 1))],
        "id LONG, active_users LONG, free_users LONG, paid_users LONG, app_status STRING,"
        " last_month_date DATE")
    rows = subscriptions.latest_snapshot(snapshots, date(2026, 3, 9)).collect()
    assert [tuple(r) for r in rows] == [(6, 4, 2, "b", "2026-03")]


def test_free_event_of_a_later_month_still_counts(log):
    one = log([event(1, "fresh_install", T), event(1, "Free User", END + timedelta(days=40)),
               event(1, "Plan Upgraded", END + timedelta(days=50)),
               event(2, "fresh_install", T), event(2, "Free User", LATER),
               event(2, "Plan Upgraded", LATER)])
    assert stores(month_state.free_without_upgrade(one.activity, one.accounts, FEBRUARY)) == [1]


def test_labels_match_in_any_usual_case(log):
    one = log([event(1, "FRESH_INSTALL", T), event(2, "fresh installs", T),
               event(3, "Re-Installs", T), event(3, "UNINSTALL", LATER)])
    assert stores(installs.surviving_installs(one.activity, one.accounts, FEBRUARY)) == [1, 2]


def test_labels_match_in_any_case(log):
    from cohortry import listed

    one = log([event(1, "fReSh_iNsTaLl", T)])
    plain = installs.surviving_installs(one.activity, one.accounts, FEBRUARY)
    usual = installs.surviving_installs(one.activity, one.accounts, FEBRUARY, vocab=listed())
    assert (stores(plain), stores(usual)) == ([1], [])


def test_store_re_opened_in_another_casing_counts(log):
    one = log([event(1, "Store Closed", T), event(1, "Store Re-opened", LATER)])
    found = reports.churn_buckets(one.activity, one.accounts, FEBRUARY).first()
    assert found.store_closed == 0


def test_events_without_a_store_are_no_store(log, spark):
    one = log([event(1, "fresh_install", T)])
    nameless = one.activity.withColumns({
        "store_client_id": F.lit(None).cast("long"), "store_name": F.lit(None).cast("string")})
    both = one.activity.unionByName(nameless)
    at_end = month_state.installed_at_month_end(both, FEBRUARY).collect()
    assert [r.store_client_id for r in at_end] == [1]
    month = events.events_per_month(both).first()
    assert (month["events"], month["active_stores"]) == (2, 1)


def test_a_column_that_is_merely_called_event_date_bounds_nothing(log):
    one = log([event(1, "fresh_install", T)])
    odd = one.activity.withColumn("event_date", F.lit(None).cast("date"))
    assert stores(installs.surviving_installs(odd, one.accounts, FEBRUARY)) == [1]


def test_open_periods_have_no_months(spark):
    with pytest.raises(ValueError, match="open"):
        period_months(spark, FEBRUARY.onwards())
    with pytest.raises(ValueError, match="last day"):
        FEBRUARY.onwards().last_day  # noqa: B018


def test_duplicate_account_keys_are_refused(spark, tmp_path):
    twins = Log(spark, tmp_path / "twins", [event(1, "install", T), event(1, "fresh_install", T)], [account(1), account(1)])
    checked = checked_accounts(twins.accounts)
    with pytest.raises(SparkRuntimeException, match="store_client_id=1 x2"):
        installs.surviving_installs(twins.activity.withColumn("created_at", F.lit(T)), checked, FEBRUARY).collect()
    with pytest.raises(SparkRuntimeException, match="not NULL"):
        checked.count()
    single = Log(spark, tmp_path / "single", [event(1, "x", T)], [account(1), account(2)])
    assert checked_accounts(single.accounts).count() == 2


def test_install_multiplicity_counts_after_the_last_churn(log):
    one = log([event(1, "fresh_install", T), event(1, "uninstall", LATER),
               event(1, "reinstall", LATER), event(1, "reinstall", LATER + TICK),
               event(2, "fresh_install", T)])
    rows = installs.install_multiplicity(one.activity, one.accounts, FEBRUARY).collect()
    assert sorted((r.store_client_id, r.install_count, r.install_type) for r in rows) == [
        (1, 2, "multiple"), (2, 1, "single")]


def test_period_helpers():
    assert FEBRUARY.utc_bounds() == (START, END)
    assert FEBRUARY.one_month and FEBRUARY.last_day == date(2026, 2, 28)
    assert not Period.days("2026-01-31", "2026-02-01").one_month
    assert Period.days("2026-01-20", "2026-03-10").whole_months() == Period.days(
        "2026-01-01", "2026-03-31")
    summer = Period.days("2026-03-01", "2026-03-31", zone="Europe/Paris")
    assert summer.utc_bounds() == (datetime(2026, 2, 28, 23), datetime(2026, 3, 31, 22))
    until = Period.until("2026-02-01", datetime(2026, 2, 5, 9))
    assert until.utc_bounds() == (START, datetime(2026, 2, 5, 3, 30) + TICK)


def test_named_zone_months_follow_daylight_saving(log):
    # 2026-03-31 22:30 UTC is already April in Paris in summer time, 2026-02-28 22:30 is not March.
    one = log([event(1, "fresh_install", datetime(2026, 3, 31, 22, 30)),
               event(2, "fresh_install", datetime(2026, 2, 28, 22, 30))],
              [account(s, created_on=NEW) for s in (1, 2)])
    spring = Period.days("2026-02-01", "2026-04-30", zone="Europe/Paris")
    rows = reports.fresh_by_month(one.activity, one.accounts, spring).collect()
    assert [tuple(r) for r in rows] == [("2026-02", 1), ("2026-04", 1)]


def test_events_belong_to_the_account_of_their_name(spark, tmp_path):
    """Account 1 has an id its events never carry; 2 has two ids in the log, of which one uninstalled."""
    moved = [event(1, "fresh_install", T) | {"store_client_id": 77},
             event(2, "fresh_install", T), event(2, "uninstall", LATER) | {"store_client_id": 78},
             event(3, "reinstall", T) | {"store_client_id": 2},
             event(3, "Onboarding completed", LATER) | {"store_client_id": 79},
             event(4, "fresh_install", T) | {"store_name": "nobody"}]
    one = Log(spark, tmp_path, moved, [account(s, created_on=OLD) for s in (1, 2, 3, 4)])
    found = month_state.installed_at_month_end(one.activity, FEBRUARY.so_far(), one.accounts, FEBRUARY)
    assert stores(found) == [1, 3]
    states = month_state.onboarding_at_month_end(one.activity, one.accounts, FEBRUARY, before=FEBRUARY)
    assert sorted((r.store_client_id, r.onboarded) for r in states.collect()) == [(1, False), (3, True)]


def test_several_names_of_one_account_are_merged(log):
    events_of_both = [event(1, "fresh_install", T), event(2, "uninstall", LATER), event(2, "Onboarding completed", T),
                      event(3, "fresh_install", LATER), event(4, "uninstall", T)]
    one = log(events_of_both)
    names = one.accounts.withColumn("store_client_id", F.expr("if(store_client_id < 3, 12, 34)"))
    names = names.withColumn("created_on", F.lit(OLD).cast("timestamp_ntz"))
    states = month_state.onboarding_at_month_end(one.activity, names, FEBRUARY, before=FEBRUARY)
    assert [(r.store_client_id, r.created_at, r.onboarded) for r in states.collect()] == [(34, LATER, False)]


def test_creation_month_events_over_month_and_zone_edges(log):
    """Creation at the edge of a local month; events a tick inside and outside of it."""
    events_at = [event(s, "x", at) for s in (1, 2) for at in (START - TICK, START, END - TICK, END)]
    one = log(events_at, [account(1, created_on=START), account(2, created_on=START - TICK)])
    spring = Period.days("2026-01-01", "2026-03-31")
    rows = churn.creation_month_events(one.activity, one.accounts, spring).collect()
    assert sorted((r.store_client_id, r.created_at) for r in rows) == [
        (1, START), (1, END - TICK), (2, START - TICK)]
    western = Period.days("2026-01-01", "2026-03-31", zone="America/Los_Angeles")
    rows = churn.creation_month_events(one.activity, one.accounts, western).collect()
    assert sorted((r.store_client_id, r.created_at) for r in rows) == [
        (s, at) for s in (1, 2) for at in (START - TICK, START)]


def test_period_to_the_present(spark, log):
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    one = log([event(1, "x", now - timedelta(minutes=1)), event(2, "x", now + timedelta(days=1)),
               event(3, "x", datetime(2025, 12, 31, 18, 30)), event(4, "x", datetime(2025, 12, 31, 18, 29))])
    until = Period.until("2026-01-01")
    assert not until.one_month and until.whole_months().hi is None
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert stores(events.in_period(one.activity, until)) == [1, 3], zone
        plan = events.in_period(one.activity, until)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"LessThanOrEqual\(created_at,20\d\d-", plan), plan
        months = [r["month"] for r in period_months(spark, until).collect()]
        assert months[0] == date(2026, 1, 1) and months[-1] == (now + timedelta(minutes=330)).date().replace(day=1)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError, match="open"):
        period_months(spark, until.onwards())
