"""Raw spellings resolved once: same classes as lower(), and a list that reaches the reader."""

import random
import re
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cohortry.functions.dictionary import LabelDictionary
from cohortry.functions.period import Period
from cohortry.functions.vocabulary import MILESTONES, VOCABULARY, EventClass
from cohortry.operators import churn, events, installs
from tests.compare import spark_rows
from tests.logs import NEW, Log, account, event

FEBRUARY = Period.month("2026-02")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Labels in random casings, of no class, empty and NULL."""
    rng = random.Random(8)
    labels = [s for c in [*VOCABULARY.values(), *MILESTONES.values()] for s in c.actions]
    labels += ["uninstall", "Uninstall?", "", None, "İnstall", "ſtore closed"]
    pages = [None, "UNinstall", "home", "Uninstall_APP", "fresh installs PAGE", "RE-installs", "it's"]

    def cased(label):
        return label and "".join(rng.choice((c.upper(), c.lower())) if c.isascii() else c for c in label)

    labels = [cased(label) for label in labels for _ in range(9)]
    made = [event(rng.randrange(90), rng.choice(labels), NEW + timedelta(minutes=rng.randrange(9000)), rng.choice(pages))
            for _ in range(4000)]
    return Log(spark, tmp_path_factory.mktemp("cased"), made, [account(s) for s in range(90)])


def test_classes_equal_lower(log):
    labels = LabelDictionary.of(log.activity)
    assert labels.complete and len(labels.entries) > 300
    folded = spark_rows(events.classify_events(log.activity))
    assert spark_rows(labels.classify(log.activity)) == folded
    assert spark_rows(events.classify_events(log.activity, labels.vocabulary())) == folded


def test_operators_agree_on_raw_spellings(log):
    vocab = LabelDictionary.of(log.activity).vocabulary()
    for build in (installs.install_status, churn.churned_events, churn.churn_buckets, churn.plan_at_churn):
        raw = build(log.activity, log.accounts, FEBRUARY, vocab=vocab)
        folded = spark_rows(build(log.activity, log.accounts, FEBRUARY))
        assert spark_rows(raw) == folded and folded[1]


def test_raw_list_reaches_the_reader(log):
    frame = log.activity.filter(LabelDictionary.of(log.activity).vocabulary()["closed"].hit())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert "In(action" in pushed and "lower" not in plan
    both = log.activity.filter(LabelDictionary.of(log.activity).vocabulary()["churn"].hit())
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*Or\(In\(action", plan) and "lower" not in plan


def test_too_many_spellings_fall_back_to_lower(log):
    labels = LabelDictionary.of(log.activity, most=5)
    assert not labels.complete and labels.entries == ()
    assert spark_rows(labels.classify(log.activity, only=["churn"])) == spark_rows(
        events.classify_events(log.activity, only=["churn"]))
    assert labels.vocabulary()["churn"].sql().startswith("(lower(action)")


def test_classes_without_a_spelling_and_empty_logs(spark, log):
    none = log.activity.filter("false")
    labels = LabelDictionary.of(none)
    assert labels.complete and labels.vocabulary()["churn"].sql() == "(false)"
    assert labels.classify(log.activity).filter(F.col("is_churn")).count() == 0
    assert labels.classify(none).count() == 0
    assert LabelDictionary.of(log.activity, {"odd": EventClass(("it isn't",))}).entries == ()
    with pytest.raises(ValueError, match="63"):
        LabelDictionary.of(none, {str(i): replace(VOCABULARY["churn"]) for i in range(64)})


def test_one_job_with_bounded_rows_to_the_driver(log):
    plan = log.activity.select("action").distinct().limit(3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in plan
    assert len(LabelDictionary.of(log.activity, most=600).entries) <= 1200
