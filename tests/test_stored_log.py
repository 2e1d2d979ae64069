"""The readers on stored tables: pruned directories, the key check inside the plan."""

import re

import pytest
from pyspark.sql import functions as F

from cohortry.functions.period import Period
from cohortry.operators import events, installs
from cohortry.sources import sample, tables

SF = "/root/testdata/sf0.01"
WEEK = Period.days("2024-01-08", "2024-01-14")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    tables.write_activity(sample.activity_e(spark, SF), f"{path}/activity")
    sample.account_e(spark, SF).write.parquet(f"{path}/account")
    return path


def test_a_period_opens_its_days_only(spark, folder):
    log = tables.read_activity(spark, f"{folder}/activity", "event_date")
    for frame in (events.in_period(log, WEEK), installs.install_multiplicity(log, tables.read_accounts(
            spark, f"{folder}/account", check=False), WEEK)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*event_date#\d+ >= 2024-01-07[^]]*<= 2024-01-14", plan), plan
    opened = events.in_period(log, WEEK).select(F.input_file_name().alias("f")).distinct().collect()
    days = {re.search(r"event_date=([\d-]+)", r["f"])[1] for r in opened}
    assert days == {f"2024-01-{d:02}" for d in range(7, 15)}
    whole = events.in_period(sample.activity_e(spark, SF), WEEK).count()
    assert events.in_period(log, WEEK).count() == whole > 0


def test_now_prunes_days_too(spark, folder):
    log = tables.read_activity(spark, f"{folder}/activity", "event_date")
    plan = events.in_period(log, Period.until("2024-01-20"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*event_date#\d+ <= 20\d\d-\d\d-\d\d\)", plan), plan


def test_rows_without_a_time_are_stored_apart(spark, tmp_path):
    rows = sample.activity_e(spark, SF).limit(50).withColumn(
        "created_at", F.when(F.col("event_id") % 2 == 0, F.col("created_at")))
    tables.write_activity(rows, f"{tmp_path}/log")
    log = tables.read_activity(spark, f"{tmp_path}/log", "event_date")
    assert log.count() == 50 and log.filter("event_date IS NULL").count() == 25
    assert events.in_period(log, Period.days("2020-01-01", "2030-01-01")).count() == 25


def test_the_key_check_adds_no_job_and_keeps_pushdown(spark, folder):
    accounts = tables.read_accounts(spark, f"{folder}/account")
    frame = accounts.filter("created_on > TIMESTAMP_NTZ'2024-01-01 00:00:00'").select("store_name")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(created_on" in plan and "ReadSchema: struct<store_name:string,created_on:timestamp_ntz>" in plan
    assert accounts.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
