"""Grouping of spelling variants by dense prefix-suffix tiles (operator 12).

Two words are near if one inserted, deleted or replaced character makes them equal. With L the longer
length that holds exactly if their common prefix and common suffix together reach L - 1 and the lengths
differ by one at most. So near words share the first or the last half of L - 1 characters, and what is
left of them is near again: the same split narrows them to a shared prefix and suffix that leave about
a quarter of the word open. Words alike in L and such a pair of ends form a block. Blocks go to tasks
as padded code-point matrices, one aligned left and one right, whose comparison gives all common
prefixes and suffixes of a block at once. A pair that meets in several blocks counts in the one that
its own prefix and suffix name first.

Blocks above ``BLOCK_WORDS`` are halved again, as often as needed: once a single character is open, a
block holds at most one word a letter and the one without it. So the work grows with the
number of words, no block is cut short, and no task gets more than ``BLOCK_WORDS`` words of one block.

A NULL text has no words; empty texts neither. Very long texts are read whole. Repeated rows count
repeatedly. Of near words of equal count the first in code-point order is the form. A NULL id counts as
empty text in the hash of the simulated typing slips. An empty table gives an empty result. Only
``doc_id`` and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import ascii_lower, prepare, shared_folder, stored, whole

LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form is at least this many times as frequent as its variant.
DOMINANCE = 10
# One run in so many loses a character.
SLIP = 31
# Words of a block that are compared at once; larger blocks are narrowed further.
BLOCK_WORDS = 512
# Cells of the comparisons that are made in one numpy operation.
CELLS = 4_000_000


def words(docs: DataFrame, text: str = "text", slip: int = SLIP) -> DataFrame:
    """``word`` and its number ``n`` of occurrences over all documents, built-in functions only."""
    # Runs are maximal: a match starts where the run does, shorter runs have no match at all.
    long_runs = F.regexp_extract_all(whole(text), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(long_runs).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    slipped = F.expr(f"""CASE WHEN h % {slip} = 0
        THEN overlay(run PLACING '' FROM CAST(h % char_length(run) AS INT) + 1 FOR 1) ELSE run END""")
    return (
        runs.select(slipped.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    )


# ---- blocks --------------------------------------------------------------------------------------


def _halves(frame: DataFrame) -> DataFrame:
    """Each row twice: half of what is open joins the shared prefix, or the shared suffix.

    ``path`` says which, a letter a halving; ``ahead`` and ``behind`` are the shared lengths.
    """
    half = F.expr("CAST((longer - ahead - behind) div 2 AS INT)")
    sides = F.explode(F.array(
        F.struct((F.col("ahead") + half).alias("ahead"), "behind", F.concat("path", F.lit("p")).alias("path")),
        F.struct("ahead", (F.col("behind") + half).alias("behind"), F.concat("path", F.lit("s")).alias("path"))))
    return frame.withColumn("side", sides).select("word", "n", "longer", "side.*")


def _keyed(frame: DataFrame) -> DataFrame:
    """With the block's key: a hash of its shared ends; what a hash joins by chance is told apart later."""
    ends = F.xxhash64(
        "longer", "path", F.expr("substring(word, 1, ahead)"), F.expr("right(word, behind)"))
    return frame.withColumn("block", ends)


def _blocks(found: DataFrame, folder: str) -> DataFrame:
    """``longer``, ``path`` and the ``members`` (word, n) of every block of two words or more."""
    key = ["block", "longer", "path"]
    # A word can be the longer one of a pair, or the shorter one.
    rows = found.select(
        "word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("longer"),
        F.lit(0).alias("ahead"), F.lit(0).alias("behind"), F.lit("").alias("path"))
    rows, turn = _keyed(_halves(_halves(rows))), 0
    sized = []
    while True:
        crowded = stored(
            rows.groupBy(*key).agg(F.count("*").alias("size"), F.max(F.expr("longer - ahead - behind")).alias("open"))
            .filter((F.col("size") > BLOCK_WORDS) & (F.col("open") > 1)).select(*key), folder, f"crowded{turn}")
        if crowded.isEmpty():
            break
        sized.append(rows.join(crowded, key, "left_anti"))
        rows = stored(_keyed(_halves(rows.join(crowded, key, "left_semi"))), folder, f"narrowed{turn}")
        turn += 1
    for done in sized:
        rows = rows.unionByName(done)
    members = F.collect_list(F.struct("word", "n"))
    return rows.groupBy(*key).agg(members.alias("members")).filter(F.size("members") > 1)


# ---- comparison ----------------------------------------------------------------------------------


def _named_path(prefix: np.ndarray, suffix: np.ndarray, longer: int, path: str) -> np.ndarray:
    """Whether this path is the one that a pair of such common ends is counted under."""
    ahead, behind, own = 0, 0, np.ones(prefix.shape, dtype=bool)
    for side in path:
        half = (longer - ahead - behind) // 2
        forward = prefix >= ahead + half
        if side == "p":
            own &= forward
            ahead += half
        else:
            own &= ~forward & (suffix >= behind + half)
            behind += half
    return own


def _aligned(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as two zero-padded matrices: from the left, and mirrored from the right."""
    at = np.arange(width)
    inside = at < lengths[:, None]
    last = max(len(codes) - 1, 0)
    left = np.where(inside, codes[np.minimum(starts[:, None] + at, last)], 0)
    right = np.where(inside, codes[np.maximum(starts[:, None] + lengths[:, None] - 1 - at, 0)], 0)
    return left, right


def near_in_blocks(
    members: list[list[str]], longer: int, path: str
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set of blocks padded to one size: block numbers, and places of near words in them.

    Words of a block are distinct. Blocks of like size are stacked and compared as one array.
    """
    sizes = np.array([len(block) for block in members])
    flat = [word for block in members for word in block]
    lengths = np.array([len(word) for word in flat])
    codes = np.frombuffer("".join(flat).encode("utf-32-le"), dtype=np.uint32)
    left, right = _aligned(codes, np.cumsum(lengths) - lengths, lengths, longer)
    firsts = np.cumsum(sizes) - sizes
    padded = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
    found = []
    for size in np.unique(padded).tolist():
        alike = np.flatnonzero(padded == size)
        step = max(1, CELLS // (size * size * longer))
        for begin in range(0, len(alike), step):
            chosen = alike[begin : begin + step]
            place = np.arange(size)
            real = place < sizes[chosen][:, None]
            rows = np.where(real, firsts[chosen][:, None] + place, 0)
            ends = []
            for matrix in (left, right):
                tile = matrix[rows]
                differs = tile[:, :, None, :] != tile[:, None, :, :]
                ends.append(np.where(differs.any(axis=3), differs.argmax(axis=3), longer))
            prefix, suffix = ends
            size_of = np.where(real, lengths[rows], -9)
            a, b = size_of[:, :, None], size_of[:, None, :]
            near = (
                (np.maximum(a, b) == longer) & (np.minimum(a, b) >= longer - 1)
                & (prefix + suffix >= longer - 1) & (prefix < longer)
                & _named_path(prefix, suffix, longer, path))
            block, one, other = np.nonzero(near)
            found.append((chosen[block], one, other))
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word with near words in a block: their number, and the best of them."""
    for batch in batches:
        longer = np.asarray(batch.column("longer"))
        path = np.asarray(batch.column("path").to_pylist(), dtype=object)
        lists = batch.column("members")
        offsets = np.asarray(lists.offsets)
        values = lists.values
        all_words = values.field("word").to_pylist()
        counts = np.asarray(values.field("n"))
        out: dict[str, list] = {"word": [], "n_near": [], "best": [], "best_n": []}
        for kind in sorted(set(zip(longer.tolist(), path.tolist(), strict=True))):
            chosen = np.flatnonzero((longer == kind[0]) & (path == kind[1]))
            blocks = [all_words[offsets[i] : offsets[i + 1]] for i in chosen]
            for block, one, other in near_in_blocks(blocks, *kind):
                start = offsets[chosen[block]]
                _best_of(start + one, start + other, all_words, counts, out)
        yield pa.record_batch({
            "word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
            "best": pa.array(out["best"], pa.string()), "best_n": pa.array(out["best_n"], pa.int64())})


def _best_of(one: np.ndarray, other: np.ndarray, all_words: list[str], counts: np.ndarray, out: dict[str, list]) -> None:
    """Adds a row for each word of ``one``: how many of ``other`` are near it, and the first of them
    by count and code point."""
    pairs = sorted(zip(one.tolist(), (-counts[other]).tolist(), [all_words[i] for i in other.tolist()], strict=True))
    last = None
    for word, count, near in pairs:
        if word != last:
            out["word"].append(all_words[word])
            out["n_near"].append(0)
            out["best"].append(near)
            out["best_n"].append(-count)
            last = word
        out["n_near"][-1] += 1


# ---- forms and roots -----------------------------------------------------------------------------


def near_words(found: DataFrame, folder: str) -> DataFrame:
    """``word``, ``n_near`` and the near word ``best`` of largest count ``best_n``, of words that have one."""
    parts = _blocks(found, folder).mapInArrow(_compare, "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", F.col("first.word").alias("best"), (-F.col("first.order")).alias("best_n"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """``word`` and the ``root`` its forms lead to, from (word, form) pairs without a circle.

    Each round every word follows its target's target, so the rounds are the logarithm of the longest
    chain; a form is ``DOMINANCE`` times as frequent as its variant, which bounds that chain by the
    digits of a count.
    """
    reached, turn = stored(forms.select("word", F.col("form").alias("root")), folder, "chain0"), 0
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reached.join(onward, "root", "left_semi").isEmpty():
            return reached
        turn += 1
        reached = stored(reached.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root")), folder, f"chain{turn}")


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word that occurs often enough."""
    prepare(docs.sparkSession)
    folder = shared_folder(docs.sparkSession)
    found = stored(words(docs, text), folder, "words")
    near = stored(near_words(found, folder), folder, "near")
    judged = found.join(near, "word", "left")
    dominant = F.col("best_n") >= DOMINANCE * F.col("n")

    def if_dominant(column: str) -> Column:
        return F.when(dominant, F.col(column))

    judged = judged.select(
        "word", if_dominant("best").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        if_dominant("best_n").alias("form_n"))
    judged = stored(judged, folder, "judged")
    chains = roots(judged.filter("form IS NOT NULL").select("word", "form"), folder)
    return judged.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
