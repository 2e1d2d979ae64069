"""Language identification, word first with backoff (operator 9).

Training counts, per language, whole words and the character n-grams of words, over all training
texts. A known word scores its log frequency in each language; an unseen one falls back to its
longest character n-grams that are known, then to shorter ones. A document's score is the sum over
its words; the best language wins.

Counts cover every training text, and every counted entry scores. The tables that workers hold have a
fixed limit: the most frequent words and n-grams, down to a count that the limit allows. Words that they
cannot resolve meet the rest of the counts in joins on Spark. Scores are whole numbers until a
document's sum is complete, so a result depends neither on the limit nor on the order of adding.

Texts that are NULL or have no letter get ``und`` with score 0, as do all texts when nothing could be
learned. Ties go to the language that sorts first. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import prepare, shared_folder, stored, whole

UNDETERMINED = "und"
# Longest n-gram first: the order of the backoff.
ORDERS = (4, 3, 2, 1)
# Cells (entries times languages) of each table that workers hold.
TABLE_CELLS = 400_000
# Log frequencies are kept in units of this; a sum over 2**30 words fits 64 bits.
UNIT = 2.0**-28
# Rows of a key above which a join serves it by broadcast; there are at most (rows / HOT_ROWS) of them.
HOT_ROWS = 50_000
# Distinct entries that a counting task holds before it sends them on.
HELD = 400_000
REMEMBERED = 300_000

find_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; empty when the text holds no letter."""
    found = find_words(text.lower())
    if found and not found[0].isalpha():  # numerals such as fractions count as word characters
        found = [w for w in found if any(map(str.isalpha, w))]
    return found


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word between two marks; a single character has no mark."""
    text = word if order == 1 else f"<{word}>"
    return [text[i : i + order] for i in range(len(text) - order + 1)]


def counted(training: DataFrame, text: str | Column = "text") -> DataFrame:
    """``lang``, ``kind`` (0: word, else the n-gram order), ``entry`` and ``n`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, seen in held.items():
                tables = {0: seen} | {order: Counter() for order in ORDERS}
                for word, n in seen.items():
                    for order in ORDERS:
                        table = tables[order]
                        for gram in grams(word, order):
                            table[gram] += n
                for kind, table in tables.items():
                    entries = list(table)
                    for at in range(0, len(entries), 50_000):
                        part = entries[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(part), pa.string()), pa.array([kind] * len(part), pa.int32()),
                             pa.array(part, pa.string()), pa.array([table[e] for e in part], pa.int64())],
                            names=["lang", "kind", "entry", "n"])
            held.clear()

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(t))
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    rows = training.select("lang", whole(text).alias("t")).mapInArrow(
        run, "lang string, kind int, entry string, n bigint")
    return rows.groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per table (words, then each n-gram order): entry -> row, and log frequencies by language.

    ``cut`` holds what the tables have no room for (``kind``, ``entry``, ``vec``), for the kinds in
    ``short``; it stays on the driver.
    """

    langs: list[str]
    rows: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]
    short: frozenset[int] = frozenset()
    cut: DataFrame | None = field(default=None, repr=False)
    known: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def backoff(self, word: str) -> list[tuple[int, int, int, np.ndarray, Counter]]:
        """Orders that may decide an unseen word, longest first: order, n-grams of the word, how many of
        them are found here, the sum of those, and the ones that only ``cut`` can tell."""
        steps = []
        for order in ORDERS:
            parts, table = grams(word, order), self.rows[order]
            found = [table[g] for g in parts if g in table]
            missing = Counter(g for g in parts if g not in table) if order in self.short else Counter()
            if found or missing:
                steps.append((order, len(parts), len(found), self.logs[order][found].sum(axis=0), missing))
            if found and (2 * len(found) >= len(parts) or order == ORDERS[-1]):
                break
        return steps

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of which at least half are known."""
        for order, parts, found, sums, _ in self.backoff(word):
            if 2 * found >= parts or order == ORDERS[-1]:
                return -(-sums // found)
        return np.zeros(len(self.langs), dtype=np.int64)

    def partial(self, text: str) -> tuple[int, np.ndarray, Counter]:
        """Number of words, sum over those that can be told here, and the other words."""
        words = words_of(text)
        total = np.zeros(len(self.langs), dtype=np.int64)
        if not words or not self.langs:
            return len(words), total, Counter()
        table, logs = self.rows[0], self.logs[0]
        known, rest = [], []
        for word in words:
            row = table.get(word)
            if row is None:
                rest.append(word)
            else:
                known.append(row)
        if known:
            total += logs[known].sum(axis=0)
        if self.short:
            return len(words), total, Counter(rest)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word in rest:
            vector = self.known.get(word)
            if vector is None:
                vector = self.known[word] = self.unseen(word)
            total += vector
        return len(words), total, Counter()

    def best(self, n_words: int, total: np.ndarray) -> tuple[str, float]:
        """Best language and its share among all, from the mean score of a word."""
        if not n_words or not self.langs:
            return UNDETERMINED, 0.0
        mean = total / n_words * UNIT
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())

    def score(self, text: str) -> tuple[str, float]:
        """``best`` of one text; for models whose tables hold everything."""
        n_words, total, rest = self.partial(text)
        if rest:
            raise ValueError("this model's tables are not complete, use identify")
        return self.best(n_words, total)


def learn(training: DataFrame, text: str | Column = "text") -> Model:
    """The model of all rows with a language; columns ``lang`` and the text."""
    spark = training.sparkSession
    prepare(spark)
    folder = shared_folder(spark)
    counts = counted(training.filter("lang IS NOT NULL"), text)
    totals = counts.groupBy("kind", "entry").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang"))
    totals = stored(totals, folder, "counts")
    per_lang = totals.select("kind", F.explode("by_lang").alias("x")).groupBy("kind", "x.lang").agg(
        F.sum("x.n").alias("n")).collect()
    langs = sorted({r["lang"] for r in per_lang})
    rows: dict[int, dict[str, int]] = {kind: {} for kind in (0, *ORDERS)}
    if not langs:
        return Model(langs, rows, {kind: np.zeros((0, 0), dtype=np.int64) for kind in rows})
    size = {r["kind"]: r["k"] for r in totals.groupBy("kind").agg(F.count("*").alias("k")).collect()}
    sums = {(r["kind"], r["lang"]): r["n"] for r in per_lang}
    shares = spark.createDataFrame(
        [(kind, [(lang, sums.get((kind, lang), 0) + 0.5 * max(1, size.get(kind, 0))) for lang in langs])
         for kind in rows], "kind int, shares array<struct<lang: string, all_of: double>>")
    # Computed in one place for the tables and for the joins, so both score alike.
    vectors = totals.join(F.broadcast(shares), "kind").withColumn("by", F.map_from_entries("by_lang")).select(
        "kind", "entry", "total", F.expr(
            f"transform(shares, s -> CAST(round(ln((coalesce(by[s.lang], 0L) + 0.5D) / s.all_of) / {UNIT!r}D)"
            " AS BIGINT))").alias("vec"))
    most = max(1, TABLE_CELLS // len(langs))
    # The lowest count that keeps a table within its limit; one row per distinct count is looked at.
    rank = Window.partitionBy("kind").orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)
    least = {r["kind"]: r["least"] for r in totals.groupBy("kind", "total").agg(F.count("*").alias("k")).withColumn(
        "upto", F.sum("k").over(rank)).filter(F.col("upto") <= most).groupBy("kind").agg(
        F.min("total").alias("least")).collect()}
    inside = F.lit(False)
    for kind, low in least.items():
        inside = inside | ((F.col("kind") == kind) & (F.col("total") >= low))
    cells: dict[int, list] = {kind: [] for kind in rows}
    for r in vectors.filter(inside).orderBy("kind", "entry").collect():
        table = rows[r["kind"]]
        cells[r["kind"]].append(r["vec"])
        table[r["entry"]] = len(table)
    logs = {kind: np.array(found, dtype=np.int64).reshape(-1, len(langs)) for kind, found in cells.items()}
    short = frozenset(kind for kind, table in rows.items() if len(table) < size.get(kind, 0))
    cut = vectors.filter(~inside).select("kind", "entry", "vec") if short else None
    return Model(langs, rows, logs, short, cut)


def looked_up(asked: DataFrame, table: DataFrame, keys: list[str], folder: str, name: str) -> DataFrame:
    """Rows of ``asked`` with the ``vec`` of their key, NULL where the table lacks it."""
    wanted = asked.groupBy(*keys).agg(F.count("*").alias("rows"))
    return served(asked, stored(wanted.join(table, keys, "left"), folder, name), keys)


def served(asked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Joins ``asked`` with one row a key, of as many ``rows`` in ``asked``; a hot key is not shuffled."""
    hot = F.broadcast(found.filter(F.col("rows") > HOT_ROWS).drop("rows"))
    cold = found.filter(F.col("rows") <= HOT_ROWS).drop("rows")
    return asked.join(hot, keys).unionByName(
        asked.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def resolved(words: DataFrame, model: Model, shared, folder: str) -> DataFrame:
    """``word``, ``rows`` and ``vec`` of distinct words that the workers' tables lack."""
    places = range(len(model.langs))
    zero = F.array(*(F.lit(0).cast("long") for _ in places))
    known = model.cut.filter("kind = 0").select(F.col("entry").alias("word"), "vec")
    words = stored(words.join(known, "word", "left"), folder, "words")

    @F.arrow_udf("array<struct<order: int, parts: bigint, found: bigint, sums: array<bigint>,"
                 " missing: array<struct<entry: string, n: bigint>>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        missing = pa.list_(pa.struct([("entry", pa.string()), ("n", pa.int64())]))
        kind = pa.list_(pa.struct([("order", pa.int32()), ("parts", pa.int64()), ("found", pa.int64()),
                                   ("sums", pa.list_(pa.int64())), ("missing", missing)]))
        for batch in batches:
            yield pa.array([[
                {"order": order, "parts": parts, "found": found, "sums": sums.tolist(),
                 "missing": [{"entry": g, "n": n} for g, n in lacking.items()]}
                for order, parts, found, sums, lacking in own.backoff(word)] for word in batch.to_pylist()], kind)

    unseen = words.filter("vec IS NULL").select("word", "rows")
    steps = stored(unseen.select("word", F.explode(run("word")).alias("s")).select("word", "s.*"), folder, "steps")
    asked = steps.select("word", F.col("order").alias("kind"), F.explode("missing").alias("m")).select(
        "word", "kind", "m.*")
    told = looked_up(asked, model.cut.filter("kind > 0"), ["kind", "entry"], folder, "grams").filter(
        "vec IS NOT NULL").groupBy("word", F.col("kind").alias("order")).agg(
        F.sum("n").alias("more"), F.array(*(F.sum(F.col("n") * F.col("vec")[i]) for i in places)).alias("added"))
    decided = steps.drop("missing").join(told, ["word", "order"], "left").select(
        "word", "order", "parts", F.expr("found + coalesce(more, 0L)").alias("found"),
        F.when(F.col("added").isNull(), F.col("sums")).otherwise(
            F.zip_with("sums", "added", lambda a, b: a + b)).alias("sums")
    ).filter(f"found > 0 AND (2 * found >= parts OR order = {ORDERS[-1]})").groupBy("word").agg(
        F.max_by(F.struct("sums", "found"), "order").alias("d")).select(
        "word", F.expr("transform(d.sums, x -> x div d.found)").alias("vec"))
    unseen = unseen.join(decided, "word", "left").select("word", "rows", F.coalesce("vec", zero).alias("vec"))
    return stored(words.filter("vec IS NOT NULL").select("word", "rows", "vec").unionByName(unseen),
                  folder, "resolved")


def identify(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document.

    The broadcast model holds at most ``TABLE_CELLS`` cells in each of its five tables. Where that is
    not everything, the words it lacks are resolved once each and joined to their documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(replace(model, cut=None, known={}))
    verdict = "lang_pred string, score double"

    def verdicts(found: list[tuple[str, float]]) -> pa.StructArray:
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=["lang_pred", "score"])

    @F.arrow_udf(verdict)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            yield verdicts([own.score(t) for t in texts.to_pylist()])

    if not model.short:
        return docs.select("doc_id", run(whole(text)).alias("p")).select("doc_id", "p.lang_pred", "p.score")

    @F.arrow_udf("n_words bigint, sums array<bigint>, rest array<struct<word: string, n: bigint>>")
    def part(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        rest = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for texts in batches:
            found = [own.partial(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())),
                 pa.array([[{"word": w, "n": n} for w, n in f[2].items()] for f in found], rest)],
                names=["n_words", "sums", "rest"])

    @F.arrow_udf(verdict)
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = shared.value
        for n_words, sums in batches:
            yield verdicts([own.best(n, np.array(total, dtype=np.int64))
                            for n, total in zip(n_words.to_pylist(), sums.to_pylist(), strict=True)])

    folder = shared_folder(spark)
    parts = stored(docs.select("doc_id", part(whole(text)).alias("p")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "p.*"), folder, "parts")
    pairs = parts.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    words = pairs.groupBy("word").agg(F.count("*").alias("rows"))
    added = served(pairs, resolved(words, model, shared, folder), ["word"]).groupBy("row").agg(
        F.array(*(F.sum(F.col("n") * F.col("vec")[i]) for i in range(len(model.langs)))).alias("added"))
    total = F.when(F.col("added").isNull(), F.col("sums")).otherwise(
        F.zip_with("sums", "added", lambda a, b: a + b))
    return parts.drop("rest").join(added, "row", "left").select(
        "doc_id", judge("n_words", total).alias("p")).select("doc_id", "p.lang_pred", "p.score")
