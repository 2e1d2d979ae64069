"""Times the reports on the sample data; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores, BENCH_ONLY a comma-separated
choice of queries. Each query runs once to warm
up; the median of the next three runs counts. ``--naive`` times the events-against-events SQL of the
same reports on the same session instead, for comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from cohortry.sources import sample
from verification.cases import SAMPLE_E, SAMPLE_O, cases

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "surviving_installs",
    "surviving_reinstalls",
    "reopened_stores",
    "conversion_summary",
    "active_by_plan",
    "first_paid_by_month",
    "report_onboarding_of_new",
    "latest_snapshot",
    "onboarding_completed_by_month",
    "onboarding_pending_by_month",
    "plan_at_churn",
    "milestones_of_churned",
    "onboarding_stop_step",
    "churn_buckets",
    "churned_unfinished",
    "report_paid_installs",
    "report_free_installs",
    "report_fresh_by_month",
    "report_installs_to_date",
    "new_not_reinstalled",
    "report_status_by_month",
    "report_install_multiplicity",
    "churned_events",
]


ONLY = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("cohortry-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def naive_query(spark: SparkSession, sql: str):
    """The plain SQL of a case on views of the sample mapping."""
    on_events = sql.startswith(SAMPLE_E)
    views = {
        "activity": sample.activity_e if on_events else sample.activity_o,
        "account": sample.account_e if on_events else sample.account_o,
        "snapshot": sample.snapshot_o,
    }
    for name, frame in views.items():
        frame(spark, SF_DIR).createOrReplaceTempView(name)
    return spark.sql(sql.removeprefix(SAMPLE_E if on_events else SAMPLE_O))


def timed(build) -> float:
    seconds = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        build().collect()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    spark = session()
    naive = "--naive" in sys.argv
    if naive:
        spark.sql(
            "CREATE TEMPORARY FUNCTION strftime(day DATE, pattern STRING) RETURNS STRING"
            " RETURN date_format(day, 'yyyy-MM')"
        )
    known = cases()
    queries = {}
    for name in ONLY or HEADLINE:
        case = known[name]
        try:
            queries[name] = timed(
                (lambda: naive_query(spark, case.sql)) if naive else (lambda: case.run(spark, SF_DIR))
            )
        except Exception as error:
            if not naive:
                raise
            print(f"{name}: {str(error).splitlines()[0][:200]}", file=sys.stderr)
    print(json.dumps({
        "metric": "naive_total_seconds" if naive else "reports_total_seconds",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
