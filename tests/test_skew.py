"""A store that holds most of the log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortry.functions.period import Period
from cohortry.functions.vocabulary import VOCABULARY
from cohortry.operators import churn, events, survival
from tests.compare import assert_same
from tests.logs import NEW, OLD, Log, account, event
from tests.operator_pairs import pairs

FEBRUARY = Period.month("2026-02")
START = datetime(2026, 2, 1)
CYCLE = ("fresh_install", "uninstall", "Re-installs", "Free Plan", "Store closed", "reopen")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    hot = [event(0, CYCLE[i % 6], START + timedelta(minutes=7 * i)) for i in range(3000)]
    rest = [event(s, CYCLE[(s + i) % 6], START + timedelta(hours=s + i, minutes=s))
            for s in range(1, 120) for i in range(1 + s % 9)]
    tail = [event(0, "reinstall", START + timedelta(days=20, minutes=i)) for i in range(500)]
    accounts = [account(s, created_on=OLD if s % 2 else NEW) for s in range(120)]
    return Log(spark, tmp_path_factory.mktemp("hot"), hot + rest + tail, accounts)


@pytest.mark.parametrize("name", [
    "surviving", "status", "multiplicity", "churned", "buckets", "creation_month", "churned_new",
    "month_end_older", "plan_at_churn"])
def test_results_hold(log, name):
    frame, sql = pairs(log, FEBRUARY)[name]
    assert assert_same(frame, log.duck, sql) > 0


def test_events_of_a_hot_store_are_dealt_out_by_hour(spark, log):
    """Seven tenths of all events in one store: no partition of the one event shuffle holds most of them."""
    churn_or_install = VOCABULARY["churn"] | VOCABULARY["install_any"]
    rows = survival._celled(events.in_period(log.activity, FEBRUARY).filter(churn_or_install.hit()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = rows.filter("store_name = 'shop-0'").count()
    assert hot > 0.7 * rows.count() and max(sizes) < hot / 2
    assert rows.groupBy("store_name", "cell").count().agg(F.max("count")).first()[0] <= 60


def test_hot_account_is_split_by_the_join(spark, log):
    """Most events in one account: the join deals them to several tasks, with thresholds to match."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    for name, value in low.items():
        spark.conf.set(name, value)
    try:
        wide = log.activity.repartition(8)
        frame = churn.creation_month_events(wide, log.accounts, FEBRUARY)
        hot = frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in low:
            spark.conf.unset(name)
    assert "skew=true" in plan, plan
    expected = pairs(log, FEBRUARY)["creation_month"][0].count()
    assert len(hot) == expected > 3000


def test_hot_store_leaves_each_map_task_as_one_row(log):
    """The store aggregation sends partial results, not events, through the shuffle."""
    plan = pairs(log, FEBRUARY)["surviving"][0]._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan.split("Exchange hashpartitioning(store_name")[1]
    assert "partial_max" in below_exchange
