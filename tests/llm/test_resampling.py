"""Importance resampling against SQL on the sample and against plain Python on edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cohortry.llm import importance, queries
from cohortry.llm.importance import Sampling
from tests.compare import assert_same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, rank string, place string, bucket int"
WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text: str | None, most: int) -> list[bytes]:
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return [
        " ".join(words[i : i + width]).encode() for width in range(1, most + 1) for i in range(len(words) - width + 1)]


def brute_force(rows, target, plan: Sampling) -> list[tuple]:
    s, t = (Counter(zlib.crc32(g) % plan.buckets for text in texts for g in grams(text, plan.most_words))
            for texts in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()) + plan.buckets, sum(t.values()) + plan.buckets
    found = []
    for doc_id, text, *_ in rows:
        codes = [zlib.crc32(g) % plan.buckets for g in grams(text, plan.most_words)]
        gains = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in codes]
        weight = sum(gains) // len(gains) if gains else 0
        name = f"{plan.seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append((doc_id, len(grams(text, 1)), len(codes), weight, score))
    long = sorted((f for f in found if f[1] >= plan.least_words),
                  key=lambda f: (-f[4], f[0] is None, f[0] or 0, f[2], f[3]))
    drawn = len(long) * plan.percent // 100
    ranked = [(*f, i + 1 if i < drawn else None) for i, f in enumerate(long)]
    return ranked + [(*f, None) for f in found if f[1] < plan.least_words]


def made_rows() -> list[tuple]:
    rng = random.Random(4)
    words = ["Straße", "abc", "x1", "Día", "日本", "the", "The", "été", "a_b", "don't", "🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += [None, "", " \x00\x7f--", "w " * 19, "w " * 20, "-a-b-", " ".join(words) * 4000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, texts[9]), (None, texts[5]), (None, texts[5])]
    rows += [(None, None), (-7, texts[8]), (90, texts[8])]
    return [(*r, "s", "r", "p", 1) for r in rows]


@pytest.mark.parametrize("plan", [
    Sampling(), Sampling(most_words=3, buckets=97, percent=40, least_words=3), Sampling(2, 10_000, 1, 100, "x")])
def test_equal_to_plain_python(spark, plan):
    rows, target = made_rows(), ["the the abc", None, "été Día x1 the"]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    got = importance.resample(docs, wanted, plan)
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(brute_force(rows, target, plan))


def test_ranks_of_one_repeated_row(spark):
    """A third and more of the rows alike in id and text: every rank once, over several ranges."""
    text = "word " * 30
    rows = [(None, text)] * 6000 + [(i, f"{text} {i}") for i in range(6000)]
    plan = Sampling(percent=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["rank"] for r in importance.resample(docs, docs, plan).collect()]
    assert sorted(got) == list(range(1, 12_001))


def test_empty_sides(spark):
    empty = spark.createDataFrame([], DOCS)
    docs = spark.createDataFrame([(1, "w " * 30, "", "", "", 1)], DOCS)
    assert importance.resample(empty, docs).count() == 0
    row = importance.resample(docs, empty, Sampling(percent=100)).first()
    assert (row["n_features"], row["rank"]) == (30, 1)


def test_sample_equals_sql(spark, duck_for):
    con = duck_for("0.01")
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert assert_same(queries.op13_resampling(spark, SF), con, queries.RESAMPLING_SQL) == 1000
