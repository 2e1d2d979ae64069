"""The pipeline's rows against the same decisions in plain Python."""

import hashlib
from collections import Counter

import duckdb
import sentencepiece
import zstandard

import corpus_pipeline
from cohortry.llm import compression_bands, mixing, queries
from tests.llm.test_operators import components_of

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    packer = zstandard.ZstdCompressor(level=3)
    kept = {}
    for i, text in sorted(docs.items()):
        words, *_, repeated = compression_bands.text_counts(text or "")
        good = compression_bands.ratios((text or "").encode(), packer, compression_bands.Bands())[-1]
        if words >= 50 and 2 * repeated <= words and good:
            kept.setdefault((text or "").encode().lower(), (i, text))
    unique = dict(kept.values())
    low = components_of(unique)
    wanted = {i: t for i, t in unique.items() if low[i] == i}

    stages = dict(corpus_pipeline.STAGES)
    found = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("quality_rules", "exact_dedup", "near_dedup"):
        found = corpus_pipeline.stored(
            stages[name](spark, found, SF), corpus_pipeline.shared_folder(spark), name)
    assert {r.doc_id: r.text for r in found.collect()} == wanted

    mixed = mixing.training_order(found).collect()
    assert {(r.doc_id, r.text) for r in mixed} <= set(wanted.items())
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = Counter()
    for r in mixed:
        ids = library.encode(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == want


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, position double"
CLEAN = [
    " ".join(f"{w}{i}" for i, w in enumerate("the old miller counted sacks of grain before a river rose".split() * 6, k))
    for k in range(0, 400, 100)]


def _run(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_edge_rows_through_the_whole_pipeline(spark, tmp_path):
    """NULL and repeated ids, NULL and empty texts, exact copies, a very long text, clashing names."""
    long = "\n".join(f"{CLEAN[0]} {i} {i * 7}" for i in range(300))
    rows = [(i, t, "en", "ab"[i % 2], 1, "r", 0.5) for i, t in enumerate(CLEAN)]
    rows += [(7, CLEAN[0].upper(), None, None, None, None, None), (1, CLEAN[1], "en", "b", 1, "r", 0.5)]
    rows += [(None, None, None, None, None, None, None), (8, "", "en", "a", 0, "r", 0.0), (9, "too short", "en", "a", 9, "r", 0.0)]
    rows += [(None, CLEAN[2] + " tail", "en", "a", 1, "r", 0.5), (10, long, "en", "a", len(long), "r", 0.5)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    known = {hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest(): t for _, t, *_ in rows if t}
    texts = {known[r.ids_sha256] for r in _run(spark, tmp_path, rows)}
    assert texts and "too short" not in texts and texts <= {t for _, t, *_ in rows}


def test_empty_table_through_the_whole_pipeline(spark, tmp_path):
    assert _run(spark, tmp_path, []) == []
