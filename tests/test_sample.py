"""The sample exercises what it is meant to: every label, every account, no column that is always 0."""

import pytest
from pyspark.sql import functions as F

from cohortry.functions.vocabulary import MILESTONES, VOCABULARY
from cohortry.sources import sample
from verification.cases import cases

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("log", [sample.activity_e, sample.activity_o])
def test_every_class_occurs(spark, log):
    classes = {**VOCABULARY, **MILESTONES}
    counts = log(spark, SF).agg(*(F.count_if(c.hit()).alias(n) for n, c in classes.items())).first().asDict()
    assert not [name for name, found in counts.items() if not found]


@pytest.mark.parametrize("accounts", [sample.account_e, sample.account_o])
def test_every_customer_is_an_account(spark, accounts):
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    found = accounts(spark, SF)
    assert found.count() == customers == found.select("store_client_id").distinct().count()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_column_is_always_empty(duck_for):
    con, vacuous = duck_for("0.01"), {}
    for name, case in cases().items():
        frame = con.execute(case.sql).df()
        empty = [c for c in frame.columns if not frame[c].fillna(0).astype(bool).any()]
        if empty or frame.empty:
            vacuous[name] = empty
    assert not vacuous
