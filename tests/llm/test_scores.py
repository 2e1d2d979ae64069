"""Scores and verdicts of operators 4, 7 and 9 against plain Python and numpy of their own, and batch limits."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard

from cohortry.llm import common, compression_bands, language_id, quality_qda, queries
from tests.llm.test_operators import DOCS, rows

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(folder, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{folder}/documents.parquet'").fetchall()


def test_quality_scores_are_density_differences(spark):
    texts = dict(documents(SF, "doc_id", "text"))
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IN (0, 1)").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    points = {i: quality_qda.statistics(t or "") for i, t in texts.items()}
    own = [np.array([points[i] for i, q in labels if q == k and i in points and not held[i]]) for k in (0, 1)]
    total = sum(map(len, own))
    spread = [np.cov(x, rowvar=False, bias=True) for x in own]
    common_spread = sum(len(x) / total * s for x, s in zip(own, spread, strict=True))
    logs = []
    for x, s in zip(own, spread, strict=True):
        shrunk = 0.7 * s + 0.3 * common_spread
        shrunk = 0.98 * shrunk + 0.02 * np.mean(np.diag(shrunk)) * np.eye(len(shrunk))
        logs.append({
            i: math.log(len(x) / total) - np.linalg.slogdet(shrunk)[1] / 2
            - (p - x.mean(axis=0)) @ np.linalg.solve(shrunk, p - x.mean(axis=0)) / 2 for i, p in points.items()})
    found = queries.op7_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        away = min(max(logs[0][r.doc_id] - logs[1][r.doc_id], -500), 500)
        assert r.score == pytest.approx(1 / (1 + math.exp(away)), abs=1e-9)
        assert r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.3)


def test_quality_of_ties_and_repeated_rows(spark):
    """Equal texts score alike; a row that is there twice counts twice in training."""
    docs = spark.createDataFrame(rows(), DOCS)
    stats = quality_qda.measured(docs).withColumn("label", docs_label())
    once = quality_qda.fit(stats)
    twice = quality_qda.fit(stats.unionByName(stats))
    assert np.allclose(once.means, twice.means) and np.allclose(once.factors, twice.factors)
    by_text = defaultdict(set)
    texts = {i: t or "" for i, t, *_ in rows() if i is not None}
    for r in quality_qda.scored(stats, once).collect():
        if r.doc_id is not None:
            by_text[texts[r.doc_id]].add(r.score)
    assert all(len(scores) == 1 for scores in by_text.values())


def docs_label():
    from pyspark.sql import functions as F

    return (F.coalesce(F.col("doc_id"), F.lit(0)) % 2).cast("int")


def plain_words(text):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [w for w in found if any(map(str.isalpha, w))]


def plain_grams(word, order):
    marked = word if order == 1 else f"<{word}>"
    return [marked[k : k + order] for k in range(len(marked) - order + 1)]


def plain_languages(training):
    """Counts of all rows with a language, and a function text -> (language, score)."""
    counts = {kind: defaultdict(Counter) for kind in range(5)}
    for text, lang in training:
        for word in plain_words(text) if lang is not None else ():
            counts[0][word][lang] += 1
            for order in (1, 2, 3, 4):
                for gram in plain_grams(word, order):
                    counts[order][gram][lang] += 1
    langs = sorted({lang for per in counts[0].values() for lang in per})
    sums = {(k, lang): sum(per[lang] for per in table.values()) + len(table) / 2
            for k, table in counts.items() for lang in langs}

    def logs(kind, entry):
        return np.array([math.log((counts[kind][entry][lang] + 0.5) / sums[kind, lang]) for lang in langs])

    def word_score(word):
        if word in counts[0]:
            return logs(0, word)
        for order in (4, 3, 2, 1):
            parts = plain_grams(word, order)
            known = [g for g in parts if g in counts[order]]
            if known and (order == 1 or 2 * len(known) >= len(parts)):
                return sum(logs(order, g) for g in known) / len(known)
        return np.zeros(len(langs))

    def predict(text):
        words = plain_words(text)
        if not words:
            return "und", 0.0
        mean = sum(map(word_score, words)) / len(words)
        odds = np.exp(mean - mean.max())
        return langs[int(np.argmax(odds))], float(odds.max() / odds.sum())

    return predict


def test_languages_by_plain_counts(spark):
    """Also of NULL and repeated rows, a very long text, unseen words and columns with clashing names."""
    given = documents(SMALL, "doc_id", "text", "lang")
    given += [(None, None, None), (-1, "", "en"), (-2, "12 ½ !", None), (-3, "gartenhausen zzyx", None)]
    given += [(-4, " ".join(t or "" for _, t, _ in given[:40]), None), *given[:3]]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, *_ in given}
    predict = plain_languages([(t, lang) for i, t, lang in given if not held[i]])
    docs = spark.createDataFrame(
        [(*row, held[row[0]], 1, "x") for row in given],
        "doc_id long, text string, lang string, held boolean, rows int, word string").repartition(3)
    found = language_id.identify(docs, language_id.learn(docs.filter("NOT held"))).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in given)
    texts = {i: t for i, t, _ in given}
    for r in found:
        lang, score = predict(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_kept_by_plain_bands(spark):
    bands = compression_bands.Bands()

    def inside(piece):
        low, high = [(lo, hi) for start, lo, hi in bands.by_bytes if len(piece) >= start][-1]
        packed = len(zstandard.ZstdCompressor(level=3).compress(piece)) if piece else 0
        return low * len(piece) <= packed <= high * len(piece)

    def keeps(text):
        data, words = text.encode(), text.encode().split()
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 2 * len(again) > len(words) or not inside(data):
            return False
        pieces = [data[k : k + 2048] for k in range(0, len(data), 2048)] if len(data) > 2048 else []
        pieces = [p for p in pieces if len(p) >= 1024]
        return 4 * sum(not inside(p) for p in pieces) <= len(pieces)

    noise = np.random.default_rng(1).integers(97, 123, 26_000, dtype=np.uint8).tobytes().decode()
    given = [(i, t) for i, t, *_ in rows()] + [(-i - 1, t) for i, t in documents(SMALL, "doc_id", "text")]
    given += [(1000 + n, " ".join(noise[k : k + 12] for k in range(0, n, 12))) for n in (900, 3000, 26_000)]
    found = compression_bands.judge(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.kept) for r in found) == Counter((i, keeps(t or "")) for i, t in given)
    assert len({r.kept for r in found if not r.base_failed}) == 2


def test_batch_limits_of_the_user_stay(spark):
    session = spark.newSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    session.conf.set(name, "50")
    common.prepare(session)
    assert session.conf.get(name) == "50"
    fresh = spark.newSession()
    common.prepare(fresh)
    assert fresh.conf.get(name) == common.BATCH_ROWS
