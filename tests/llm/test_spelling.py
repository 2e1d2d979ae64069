"""Spelling variants against SQL on the sample and against pairwise edits on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortry.llm import queries, spelling_variants
from cohortry.llm.common import shared_folder
from tests.compare import assert_same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, word string, n int, path string, longer string"


def lowered(run: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in run)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows) -> set[tuple]:
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[word] += len(word) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best and counts[best] >= 10 * counts[word] else None
    result = set()
    for word in counts:
        root = word
        while form[root]:
            root = form[root]
        result.add((word, form[word], root, counts[word], len(near[word]), counts.get(form[word])))
    return result


def made_rows() -> list[tuple]:
    rng = random.Random(3)
    base = ["".join(rng.choice("aabéÿz") for _ in range(rng.randrange(6, 13))) for _ in range(60)]
    words = []
    for word in base:
        words += [word] * rng.choice((1, 2, 3, 25, 300))
        for _ in range(4):
            at = rng.randrange(len(word) + 1)
            words += [word[:at] + rng.choice(["", "a", "ç"]) + word[at + rng.randrange(2) :]] * rng.choice((1, 2, 20))
    rng.shuffle(words)
    parts = [" ".join(words[i::9]) for i in range(9)]
    long = "\n".join(rng.choice(base) for _ in range(60_000))
    return [
        *((i, part, "w", 1, "p", "l") for i, part in enumerate(parts)), (3, parts[3], "w", 1, "p", "l"),
        (None, parts[0].upper(), None, None, None, None), (20, None, "", 0, "", ""), (21, "", "", 0, "", ""),
        (22, long, "", 0, "", ""), (23, "Ünïcode-ÉÉÉÉÉÉÉ×abcdefg÷ 日本語 abcdefg", "", 0, "", ""),
        (24, "Ünïcode ÉÉÉÉÉÉÉ×abcdefg", "", 0, "", ""),
    ]


@pytest.mark.parametrize("block_words", [512, 8])
def test_equal_to_pairwise_edits(spark, monkeypatch, block_words):
    """Also with blocks so small that they are narrowed several times."""
    monkeypatch.setattr(spelling_variants, "BLOCK_WORDS", block_words)
    rows = made_rows()
    frame = spelling_variants.variants(spark.createDataFrame(rows, DOCS))
    found = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_force(rows)
    assert any(f[1] for f in found) and any(f[2] not in (f[0], f[1]) for f in found)


def test_crowded_blocks_stay_small(spark):
    """Words that share all but a few characters: a third of all words in one block."""
    rng = random.Random(9)
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
    found = {f"constant{a}{b}{c}x" for a in letters[:16] for b in letters[:16] for c in letters[:16]}
    found |= {"".join(rng.choice(letters) for _ in range(rng.randrange(7, 15))) for _ in range(8000)}
    frame = spark.createDataFrame([(w, rng.randrange(2, 90)) for w in sorted(found)], "word string, n long")
    blocks = spelling_variants._blocks(frame, shared_folder(spark)).selectExpr("size(members) AS size").collect()
    assert max(r["size"] for r in blocks) <= spelling_variants.BLOCK_WORDS
    near = {r["word"]: r["n_near"] for r in spelling_variants.near_words(frame, shared_folder(spark)).collect()}
    holes = Counter()
    for word in found:
        holes.update({(i, word[:i] + word[i + 1 :]) for i in range(len(word))})
    for word in list(found)[:500]:
        same = sum(holes[i, word[:i] + word[i + 1 :]] - 1 for i in range(len(word)))
        shorter = len({word[:i] + word[i + 1 :] for i in range(len(word))} & found)
        longer = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} & found
        assert near.get(word, 0) == same + shorter + len(longer)


def test_tile_comparison_alone():
    words = ["abcdefgh", "abcdefg", "abcdexgh", "bcdefgh", "zzzzzzzz"]
    found = spelling_variants.near_in_blocks([words], 8, "")
    pairs = {(words[a], words[b]) for _, one, other in found for a, b in zip(one, other, strict=True)}
    assert pairs == {(a, b) for a in words for b in words if one_edit(a, b) and max(len(a), len(b)) == 8}
    assert all(isinstance(block, np.ndarray) for block, _, _ in found)


def test_sample_equals_sql(spark, duck_for):
    con = duck_for("0.01")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert assert_same(queries.op12_spelling(spark, SF), con, queries.SPELLING_SQL) > 1000


def test_empty_tables(spark):
    empty = spelling_variants.variants(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
