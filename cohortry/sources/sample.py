"""Activity, account and snapshot tables mapped from the sample star schema.

``events`` and ``customer`` give a dense one-month log, ``orders`` and ``customer`` an 80-month log
with real ties. Each is a lazy projection; no table is copied. A customer's name and the creation of
its account follow from the key, so neither table needs a join. Both logs use every label of the vocabulary.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The sample's columns that the mapping uses; a fixed schema saves the footer job of inference.
COLUMNS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_mktsegment STRING",
}

# Labels of an event, a row a remainder of its id, in a row by the remainder of the shop's key: in the
# casings and spellings that occur, and every step, plan and milestone reached by some shops only.
EVENT_LABELS = {
    "signup": (
        ("fresh_install",), ("Fresh Installs",), ("re-Installs",), ("reinstall",), ("FRESH INSTALL",),
        ("re_install",), ("install",)),
    "error": (
        ("Store closed",), ("Paid uninstalled", "crash", "crash"), ("uninstall",), ("UNINSTALL",),
        ("UNINSTALLED",), ("app_uninstall",), ("error page",)),
    "view": (
        ("free plan", "Free Plan", "free plan", "free plan"),
        ("Plan Downgraded", "viewed", "Free User", "Free User"),
        ("During trial", "During trial", "During trial", "viewed", "viewed")),
    "purchase": (
        ("Charge Approved",), ("Plan Upgraded",), ("pricing_plan_type-2",), ("Pricing_Plan_Type-3",),
        ("pricing_plan_type-4",), ("invoice",)),
    "click": (
        ("help", *["PC-onboarding-step-1"] * 4), ("help", "help", *["SPLD-onboarding-step-2"] * 3),
        ("help", "help", "help", *["PC-onboarding-step-3"] * 2), (*["help"] * 4, "Onboarding completed"),
        ("help", *["SPLD-onboarding-step-1"] * 4), ("App enabled-odd",), ("Calendar Placement (Default)",),
        ("Delivery Method Enabled",), ("Date-picker — Enabled",), ("Time-picker — Enabled",),
        ("Google Maps API Key Added",), ("Checkout Widget Enabled",), ("Scheduled Order Placed",),
        ("Store Re-opened",), ("Reopen",), ("App Enabled",)),
}
ORDER_LABELS = {
    "1-URGENT": (("fresh_install",), ("Fresh Installs",), ("fresh install",), ("reopen",), ("fresh_Install",)),
    "2-HIGH": (("re-installs",), ("Reinstall",), ("RE_INSTALL",), ("re installs",)),
    "3-MEDIUM": (
        ("uninstall",), ("UNINSTALL",), ("Uninstall",), ("Paid uninstalled",), ("Store closed",),
        ("app_uninstall",)),
    "4-NOT SPECIFIED": (
        ("PC-onboarding-step-1",), ("SPLD-onboarding-step-2",), ("PC-onboarding-step-3",),
        ("App enabled-odd",), ("Calendar Placement (Default)",), ("Delivery Method Enabled",),
        ("Date-picker — Enabled",), ("Time-picker — Enabled",), ("Google Maps API Key Added",),
        ("Checkout Widget Enabled",), ("Scheduled Order Placed",), ("Onboarding—completed",),
        ("Onboarding completed",)),
    "5-LOW": (
        ("Free User",), ("During trial",), ("Plan Downgraded",), ("Charge Approved",),
        ("pricing_plan_type-2",), ("Free Plan",), ("Plan Upgraded",), ("plan upgraded",)),
}


def label_sql(labels: dict[str, tuple], kind: str, event: str, shop: str, literal: str, first: int) -> str:
    """SQL text that looks an event's label up in a literal list, whose dialect ``literal`` and the number
    ``first`` of its first place describe."""
    cases = []
    for value, rows in labels.items():
        width = lcm(*map(len, rows))
        flat = ", ".join(f"'{row[i % len(row)]}'" for row in rows for i in range(width))
        at = f"CAST({event} % {len(rows)} * {width} + {shop} % {width} + {first} AS INT)"
        cases.append(f"WHEN '{value}' THEN {literal.format(flat)}[{at}]")
    return f"CASE {kind} {' '.join(cases)} END"


EVENT_ACTION = label_sql(EVENT_LABELS, "event_type", "event_id", "user_id", "array({})", 0)
ORDER_ACTION = label_sql(ORDER_LABELS, "o_orderpriority", "o_orderkey", "o_custkey", "array({})", 0)

EVENT_PAGE = """CASE
    WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 197 = 0 THEN 'uninstall'
    WHEN event_id % 211 = 0 THEN 'Uninstall_App'
    WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'Fresh Installs page'
    WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 're-installs'
    ELSE event_type END"""

ORDER_PAGE = """CASE
    WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 173 = 0 THEN 'UNINSTALL_APP'
    WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'Fresh Installs page'
    WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 3 != 0 THEN 're-installs'
    ELSE 'home' END"""

# Every third shop of the long log lives within one month, several events a day; the others' events lie
# at midnight, which gives ties.
ORDER_TIME = """CASE WHEN o_custkey % 3 = 0
    THEN TIMESTAMP_NTZ'1995-01-01 00:00:00' + make_ym_interval(0, CAST(o_custkey % 79 AS INT))
        + make_dt_interval(dayofmonth(o_orderdate) - 1, CAST(o_orderkey % 4 * 6 AS INT))
    ELSE o_orderdate END"""

# Some events of the long log carry an id the shop had before; its name is the same.
ORDER_ID = "CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 10000000 ELSE o_custkey END"

CREATED_E = """TIMESTAMP_NTZ'2023-11-25 00:00:00'
    + make_dt_interval(CAST(c_custkey * 7 % 60 AS INT), CAST(c_custkey % 24 AS INT))"""

CREATED_O = """CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP_NTZ'1994-05-01 00:00:00' WHEN c_custkey % 3 = 0
    THEN TIMESTAMP_NTZ'1995-01-01 00:00:00' + make_ym_interval(0, CAST(c_custkey % 79 AS INT))
        - make_dt_interval(CAST(c_custkey % 2 * 40 AS INT))
    ELSE TIMESTAMP_NTZ'1994-07-01 00:00:00' + make_dt_interval(CAST(c_custkey * 37 % 1400 AS INT)) END"""

ACCOUNT_EMAIL = """CASE
    WHEN c_custkey % 13 = 0 THEN NULL
    WHEN c_custkey % 7 = 0 THEN concat('u', c_custkey, '@internal.example')
    ELSE concat('u', c_custkey, '@shop.example') END"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _named(key: str) -> str:
    return f"concat('Customer#', lpad(CAST({key} AS STRING), 9, '0')) AS store_name"


def activity_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS store_client_id", _named("user_id"),
        f"{EVENT_ACTION} AS action", f"{EVENT_PAGE} AS page", "ts AS created_at",
    )


def activity_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS event_id", f"{ORDER_ID} AS store_client_id", _named("o_custkey"),
        f"{ORDER_ACTION} AS action", f"{ORDER_PAGE} AS page", f"{ORDER_TIME} AS created_at",
    )


def _accounts(spark: SparkSession, sf_dir: str, created_on: str) -> DataFrame:
    """Every customer is an account, with or without events; all columns follow from its row."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS store_client_id",
        "c_name AS store_name",
        "c_mktsegment AS shop_plan",
        "if(c_custkey % 10 = 0, NULL, c_mktsegment) AS plan_display_name",
        f"{created_on} AS created_on",
        "CAST(c_custkey % 3 AS STRING) AS charge_approve",
        "if(c_custkey % 5 = 0, '0', '1') AS status",
        f"{ACCOUNT_EMAIL} AS email",
    )


def account_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir, CREATED_E)


def account_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir, CREATED_O)


def snapshot_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly snapshots, one per (month, order status); ids grow with (month, status)."""
    per_customer = (
        _table(spark, sf_dir, "orders")
        .selectExpr(
            "trunc(CAST(o_orderdate AS DATE), 'MM') AS last_month_date",
            "o_orderstatus AS app_status", "o_custkey", "o_orderpriority = '1-URGENT' AS urgent",
        )
        .groupBy("last_month_date", "app_status", "o_custkey")
        .agg(F.max("urgent").alias("paid"))
    )
    totals = per_customer.groupBy("last_month_date", "app_status").agg(
        F.count("*").alias("active_users"), F.count_if("paid").alias("paid_users")
    )
    return totals.selectExpr(
        """CAST((year(last_month_date) * 12 + month(last_month_date)) * 3
            + CASE app_status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS id""",
        "active_users", "active_users - paid_users AS free_users", "paid_users",
        "app_status", "last_month_date",
    )
