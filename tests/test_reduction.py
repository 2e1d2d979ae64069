"""The bitmap of selected stores: no row of theirs is lost, few others stay, its size is bounded."""

from pyspark.sql import functions as F

from cohortry.functions.vocabulary import VOCABULARY
from cohortry.operators import reduction
from cohortry.operators.profile import ever, last
from cohortry.operators.reduction import key_bits, rows_of, with_facts
from tests.compare import spark_rows
from tests.logs import NEW, OLD, Log, account, event


def test_rows_of_the_keys_stay_and_few_others(spark):
    log = spark.range(200_000).select(F.col("id").alias("event_id"), (F.col("id") % 50_000).alias("store"))
    kept = rows_of(log, spark.range(0, 50_000, 10).select(F.col("id").alias("store")), "store")
    assert kept.columns == log.columns
    wanted = kept.filter("store % 10 = 0").count()
    assert wanted == 20_000 and kept.count() - wanted < 200


def test_text_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(i, name) for i, name in enumerate(["a", "b", None, "a", "é", ""])], "event_id int, store_name string")
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "store_name string")
    assert sorted(r["event_id"] for r in rows_of(rows, keys, "store_name").collect()) == [0, 3, 5]
    none = spark.createDataFrame([], "store_name string")
    assert rows_of(rows, none, "store_name").count() == 0


def test_bitmap_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(reduction, "SLOTS", 1 << 10)
    keys = spark.range(100_000).select(F.col("id").alias("k"))
    assert key_bits(keys, "k").count() <= (1 << 10) / 64
    # A full bitmap leaves nothing out, and nothing goes wrong.
    assert rows_of(keys, keys, "k").count() == 100_000


def test_full_bitmap_changes_no_fact(spark, monkeypatch, tmp_path):
    events = [event(s, a, NEW) for s in range(60) for a in ("Free User", "uninstall")[: 1 + s % 2]]
    log = Log(spark, tmp_path, events, [account(s, created_on=OLD) for s in range(60)])
    stores = log.accounts.filter("store_client_id % 3 = 0").select("store_name")
    facts = {"free": ever(VOCABULARY["free_user"]), "trial": ever(VOCABULARY["trial"]),
             "gone": last(VOCABULARY["uninstall_only"])}
    wide = spark_rows(with_facts(stores, log.activity, "store_name", **facts))
    monkeypatch.setattr(reduction, "SLOTS", 64)
    assert spark_rows(with_facts(stores, log.activity, "store_name", **facts)) == wide
    assert sum(wide[1].values()) == 20
