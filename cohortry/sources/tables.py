"""The three input tables: schemas, readers, load checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.period import stored_by_day

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("store_client_id", T.LongType()),
    T.StructField("store_name", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("store_client_id", T.LongType()),
    T.StructField("store_name", T.StringType()),
    T.StructField("shop_plan", T.StringType()),
    T.StructField("plan_display_name", T.StringType()),
    T.StructField("created_on", T.TimestampNTZType()),
    T.StructField("charge_approve", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("email", T.StringType()),
])

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("active_users", T.LongType()),
    T.StructField("free_users", T.LongType()),
    T.StructField("paid_users", T.LongType()),
    T.StructField("app_status", T.StringType()),
    T.StructField("last_month_date", T.DateType()),
])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_activity(spark: SparkSession, path: str, day_column: str | None = None) -> DataFrame:
    """The event log. ``day_column`` names the partition column of a log stored by UTC day (see
    :func:`write_activity`); period filters then prune its directories."""
    if day_column is None:
        return read_parquet(spark, path, ACTIVITY_SCHEMA)
    by_day = T.StructType([*ACTIVITY_SCHEMA.fields, T.StructField(day_column, T.DateType())])
    return stored_by_day(read_parquet(spark, path, by_day), day_column)


def write_activity(activity: DataFrame, path: str, day_column: str = "event_date") -> None:
    """Stores a log by UTC day, rows of a day in order of time: a day's files and row groups cover
    short spans, and a day of very many events is written by several tasks."""
    columns = [field.name for field in ACTIVITY_SCHEMA.fields]
    days = activity.select(*columns).withColumn(day_column, F.to_date("created_at"))
    ordered = days.repartitionByRange(day_column, "created_at").sortWithinPartitions(day_column, "created_at")
    ordered.write.partitionBy(day_column).parquet(path)


def read_accounts(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The account dimension; with ``check`` queries on it fail when a key is NULL or repeated."""
    accounts = read_parquet(spark, path, ACCOUNT_SCHEMA)
    return checked_accounts(accounts) if check else accounts


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, SNAPSHOT_SCHEMA)


def account_key_violations(accounts: DataFrame) -> DataFrame:
    """Keys of the account dimension that are NULL or repeated: one row per key and value."""
    def bad(key: str) -> DataFrame:
        return (
            accounts.groupBy(F.col(key).cast("string").alias("value"))
            .agg(F.count("*").alias("rows"))
            .filter(F.col("value").isNull() | (F.col("rows") > 1))
            .select(F.lit(key).alias("key"), "value", "rows")
        )

    return bad("store_name").unionByName(bad("store_client_id"))


def checked_accounts(accounts: DataFrame) -> DataFrame:
    """The accounts, in a plan that fails when a key is NULL or repeated.

    The test is a subquery of every query on them, not a job of its own. It reads the key columns only, and
    filters and columns of the query still reach the reader of the accounts themselves.
    """
    shown = F.concat_ws("=", "key", F.coalesce("value", F.lit("NULL")))
    found = account_key_violations(accounts).agg(F.min(F.concat(shown, F.lit(" x"), "rows")).alias("found"))
    message = F.concat(F.lit("account keys must be unique and not NULL: "), found.scalar())
    sound = F.when(found.scalar().isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return accounts.filter(sound)
