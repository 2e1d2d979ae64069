"""What the plans must look like to hold at scale."""

import re
from datetime import datetime

import pytest

from cohortry.functions.period import Period, stored_by_day
from cohortry.operators import events, installs
from tests.logs import NEW, Log, account, event
from tests.operator_pairs import pairs

PERIODS = {"month": Period.month("2026-02"), "quarter": Period.days("2026-01-20", "2026-03-10")}
FEBRUARY = PERIODS["month"]

# Operators that return or count single events; their windows over events are keyed by store and hour.
EVENT_LEVEL = {"multiplicity", "churned", "creation_month"}
# Facts over the whole log of the stores that the period selects.
REDUCED = {"plan_at_churn", "plan_simple", "unfinished", "unfinished_simple"}
# Operators that need the whole log, or look at accounts only.
WHOLE_LOG = {"classify", "per_month", "cohort", "active", "converted_older", "stayed_free_older",
             "plan_at_churn", "plan_simple", "unfinished", "unfinished_simple"}


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    return Log(spark, tmp_path_factory.mktemp("log"),
               [event(1, "fresh_install", NEW)], [account(1)])


@pytest.fixture(scope="module")
def plans(spark, log):
    """Static physical plans by period and operator, with exchange reuse."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return {
            label: {
                name: frame._jdf.queryExecution().executedPlan().toString()
                for name, (frame, _) in pairs(log, period).items()
            }
            for label, period in PERIODS.items()
        }
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def log_scans(plan: str) -> list[str]:
    return re.findall(r"FileScan parquet [^\n]*activity\.parquet[^\n]*", plan)


@pytest.mark.parametrize("label", PERIODS)
def test_one_scan_and_no_pairwise_join(plans, label):
    for name, plan in plans[label].items():
        assert len(log_scans(plan)) <= (2 if name in REDUCED else 1), f"{name}\n{plan}"
        assert "NestedLoop" not in plan and "Cartesian" not in plan, f"{name}\n{plan}"


@pytest.mark.parametrize("label", PERIODS)
@pytest.mark.parametrize("name", sorted(REDUCED))
def test_whole_log_facts_meet_the_selected_stores_first(plans, label, name):
    """One scan of the period; the other scan joins the stores' bitmap below its partial aggregation."""
    scans = log_scans(plans[label][name])
    bounded = [s for s in scans if re.search(r"GreaterThanOrEqual\(created_at", s)]
    assert len(scans) == 2 and len(bounded) == 1, plans[label][name]
    lines = plans[label][name].splitlines()
    whole = next(i for i, x in enumerate(lines) if "activity.parquet" in x and "GreaterThanOrEqual(created_at" not in x)
    exchange = max(i for i in range(whole) if "Exchange hashpartitioning" in lines[i])
    steps = [re.search(r"[A-Z][A-Za-z]+", x)[0] for x in lines[exchange + 1 : whole]]
    assert steps.index("HashAggregate") < steps.index("BroadcastHashJoin"), steps


@pytest.mark.parametrize("label", PERIODS)
def test_everything_stays_in_generated_code(plans, label):
    for name, plan in plans[label].items():
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, f"{name}\n{plan}"
        assert "EvalPython" not in plan and "InPandas" not in plan, name
        for line in plan.splitlines():
            if "HashAggregate" in line or re.search(r"[-:] *(Filter|Project)", line):
                assert "*(" in line, f"{name}: {line[:200]}"


@pytest.mark.parametrize("label", PERIODS)
def test_windows_run_over_aggregated_rows_only(plans, label):
    for name, plan in plans[label].items():
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line) and not re.search(r"\[store_name#\d+, cell#\d+\]$", line):
                below = lines[i:]
                upper = next(j for j, x in enumerate(below) if "HashAggregate" in x or "ReusedExchange" in x)
                assert not any("FileScan" in x for x in below[:upper]), name


def test_one_month_reports_need_no_window(plans):
    for name, plan in plans["month"].items():
        if not name.startswith("stayed_free") and name not in {"multiplicity", "churned"}:
            assert "Window" not in plan, name


def test_log_rows_are_aggregated_before_they_are_shuffled(plans):
    """The first exchange above each log scan carries partial results, not events."""
    for name, plan in plans["month"].items():
        if name in EVENT_LEVEL:
            continue
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "FileScan" in line and "activity.parquet" in line:
                exchanges = [j for j in range(i) if "Exchange" in lines[j]]
                between = lines[exchanges[-1]:i] if exchanges else []
                assert not exchanges or any("HashAggregate" in x for x in between), name


def test_period_and_columns_reach_the_reader(spark, log):
    frame = events.in_period(log.activity, FEBRUARY).select("store_name")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lo, hi = FEBRUARY.utc_bounds()
    assert f"GreaterThanOrEqual(created_at,{lo:%Y-%m-%dT%H:%M})" in plan
    assert f"LessThan(created_at,{hi:%Y-%m-%dT%H:%M})" in plan
    assert "ReadSchema: struct<store_name:string,created_at:timestamp_ntz>" in plan


def test_every_period_operator_pushes_the_period(plans):
    for name, plan in plans["month"].items():
        if name not in WHOLE_LOG:
            for scan in log_scans(plan):
                assert re.search(r"(GreaterThanOrEqual|LessThan)\(created_at", scan), name


def test_account_cohort_reaches_the_reader(plans):
    scan = next(x for x in plans["month"]["surviving"].splitlines() if "account.parquet" in x)
    assert "GreaterThanOrEqual(created_on" in scan and "LessThan(created_on" in scan


def test_day_partitions_are_pruned(spark, log, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "by_day")
    days = log.activity.withColumn("event_date", F.to_date("created_at"))
    days.write.partitionBy("event_date").parquet(path)
    stored = stored_by_day(spark.read.parquet(path), "event_date")
    for frame in (
        installs.surviving_installs(stored, log.accounts, FEBRUARY),
        installs.install_multiplicity(stored, log.accounts, FEBRUARY),
        events.in_period(stored, FEBRUARY),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)
        wanted = [f for f in found if "event_date" in f]
        assert wanted and all("2026-01-31" in f and "2026-02-28" in f for f in wanted), plan
        assert frame.count() == 1


def test_session_zone_does_not_change_results(spark, log):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            frame = installs.surviving_installs(log.activity, log.accounts, FEBRUARY)
            found.append([r.created_at for r in frame.collect()])
        assert found[0] == found[1] == [datetime(2026, 2, 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
