"""Quality classifier: regularised quadratic discriminant (operator 7).

Each text gives a vector of document statistics: lengths, repetition, and shares of kinds of
characters, transformed by logarithms so that classes come nearer to normal. Training sums counts,
vectors and their outer products per class over all labelled rows; class covariances shrink towards
the pooled one and towards a multiple of the identity. A score is the logistic function of the
difference of log densities, Mahalanobis distances included, plus the log odds of the classes. The
inverse Cholesky factors are computed once and go to the workers with the model.

NULL and empty texts have statistics like any other text and get a score. With rows of one class
only, or of none, every score is the share of label 1, or 0.5. Rows that share an id count once per
label and row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import prepare, whole

SYMBOLS = "#*$%&|<>~^_=+@\\/{}[]"
FEATURES = (
    "n_words", "word_length", "distinct_words", "same_as_before", "dup_lines", "line_words",
    "upper", "digits", "symbols", "bangs", "stops", "not_letters", "words_ending_in_symbol",
)

_codes = np.arange(257)
_is = lambda test: np.array([c < 256 and test(chr(c)) for c in _codes], dtype=float)
_UPPER, _LETTER, _DIGIT = _is(str.isupper), _is(str.isalpha), _is(str.isdigit)
_LETTER[256] = 1.0
_SYMBOL, _BANG, _STOP = _is(SYMBOLS.__contains__), _is("!?".__contains__), _is(".,;:".__contains__)
_BLANK = _is(" \t\n\v\f\r".__contains__)


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a text, in the order of ``FEATURES``."""
    words = text.encode().split()
    n = len(words)
    chars = np.bincount(
        np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), 256).astype(np.int64), minlength=257)
    solid = max(1.0, float(chars.sum() - chars @ _BLANK))
    letters = max(1.0, float(chars @ _LETTER))
    lines = [line for line in text.split("\n") if line]
    share = lambda part, of: float(np.log((part + 0.2) / (of + 20.0)))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(w[-1:] in b"#*$%&|!" for w in words)
    return np.array([
        np.log1p(n),
        np.log(solid / max(1, n) + 0.5),
        np.log((len(set(words)) + 1) / (n + 1)),
        share(repeats, n),
        share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(n / max(1, len(lines))),
        share(chars @ _UPPER, letters),
        share(chars @ _DIGIT, solid),
        share(chars @ _SYMBOL, solid),
        share(chars @ _BANG, solid),
        share(chars @ _STOP, solid),
        share(solid - chars @ _LETTER, solid),
        share(ends, n),
    ])


def measured(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """``doc_id`` and its ``stats``."""
    prepare(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [statistics(t) for t in texts.to_pylist()]
            flat = np.concatenate(rows) if rows else np.array([])
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64()))

    return docs.select("doc_id", run(whole(text)).alias("stats"))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log odds; or a fixed score."""

    fixed: float | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(stats), self.fixed)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            away = (stats - mean) @ factor.T
            logs.append(constant - 0.5 * (away * away).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def moments(training: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label the number of rows, the sum and the sum of outer products of ``stats``.

    Tasks send sums only: a fixed number of values each.
    """
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            stats = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            for label in (0, 1):
                own = stats[labels == label]
                sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        label, place = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.ravel().astype(np.int32)), pa.array(place.ravel().astype(np.int32)),
             pa.array(sums.ravel())], names=["label", "place", "value"])

    rows = training.select(F.col("label").cast("int"), "stats").mapInArrow(
        run, "label int, place int, value double")
    table = np.zeros((2, 1 + d + d * d))
    for r in rows.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        table[r["label"], r["place"]] = r["value"]
    return {k: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for k, t in enumerate(table)}


def fit(training: DataFrame, pooled: float = 0.3, ridge: float = 0.02) -> Discriminant:
    """The discriminant of all rows with ``label`` 0 or 1 and ``stats``.

    ``pooled`` is the weight of the common covariance in each class's own, ``ridge`` that of the
    identity times the mean variance.
    """
    found = moments(training.filter("label IN (0, 1)"))
    sizes = np.array([found[k][0] for k in (0, 1)])
    if not sizes.all():
        return Discriminant(fixed=float(sizes[1] / sizes.sum()) if sizes.sum() else 0.5)
    d = len(FEATURES)
    means = np.array([s / n for n, s, _ in found.values()])
    within = np.array([q / n - np.outer(m, m) for (n, _, q), m in zip(found.values(), means, strict=True)])
    common = np.tensordot(sizes / sizes.sum(), within, axes=1)
    factors, constants = [], []
    for k in (0, 1):
        cov = (1 - pooled) * within[k] + pooled * common
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        cholesky = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(cholesky))
        constants.append(np.log(sizes[k] / sizes.sum()) - np.log(np.diag(cholesky)).sum())
    return Discriminant(means=means, factors=np.array(factors), constants=np.array(constants))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """The frame with a ``score`` from its ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    d = len(FEATURES)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(shared.value.scores(np.array(rows.to_pylist()).reshape(-1, d)), pa.float64())

    return stats.withColumn("score", run("stats"))
