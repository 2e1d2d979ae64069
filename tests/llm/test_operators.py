"""The operators against brute force, the libraries or SQL, on edge rows: NULLs, empty and long
texts, ties, repeated rows, extra columns with clashing names, empty tables."""

import hashlib
import io
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from cohortry.llm import (
    bitpack,
    chat,
    common,
    compression_bands,
    content_sort,
    language_id,
    merges,
    mixing,
    prefix_join,
    quality_qda,
    queries,
    sentencepiece_codec,
    token_counts,
)
from tests.compare import assert_same

PIECES = queries.tokenizer_path("piece_bpe_32k.model")
BYTES = queries.tokenizer_path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, norm string, kept int"
PROSE = "The old miller counted seven sacks of grain before the river rose over its banks again"


def rows() -> list[tuple]:
    rng = random.Random(5)
    words = PROSE.split()
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(9000))
    near = long.split()[:400]
    changed = near[:200] + ["other"] + near[201:]
    texts = [
        None, "", " \n\t ", PROSE, PROSE.upper(), PROSE.lower(), "É" + PROSE, "é" + PROSE, long, long,
        " ".join(near), " ".join(changed), "a  b \n c  d<|endoftext|> e", "word " * 300, "x" * 5000,
        "line\nline\n\n" * 30, "⅓ 12 — ½", "one two three four", "one two three four",
    ]
    made = [(i, t, "en" if i % 3 else None, ["b", "a", None][i % 3]) for i, t in enumerate(texts)]
    made += [made[3], made[9], (None, PROSE, "fr", "a"), (None, None, None, None)]
    return [(i, t, lang, src, len(t or ""), "r", "n", 1) for i, t, lang, src in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def counted(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_merges_equal_the_library():
    rng = random.Random(1)
    letters = "ab \n\t  théñ▁—日本𝒳🙂<s></s><unk><0x0A>́\x00\r'x12  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(1500)]
    texts += ["", " ", "▁", "\n\n", "a" * 700, "<s> hi </s>"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = merges.vocabulary(PIECES)
    assert [vocab.encode(t) for t in texts] == library.encode(texts)
    chunks = sorted({c for t in texts for c in vocab.chunks(t)})
    assert vocab.encode_chunks(chunks) == [vocab.encode_chunk(c) for c in chunks]


def test_sentencepiece_round_trip(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {t or "": library.encode(t or "") for _, t, *_ in rows()}
    coded = sentencepiece_codec.encode_decode(docs, PIECES).collect()
    want = Counter((i, tuple(ids[t or ""]), library.decode(ids[t or ""])) for i, t, *_ in rows())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in coded) == want
    assert sentencepiece_codec.digests(sentencepiece_codec.encode_decode(empty, PIECES)).collect() == []


def test_token_counts(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in rows())
    assert counted(token_counts.count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, PIECES).collect() == []
    proved = token_counts.whole_tokens(PIECES)
    assert all(len(merges.vocabulary(PIECES).encode_chunk(s)) == 1 for s in random.Random(2).sample(proved, 500))


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packing_and_random_access(bits):
    rng = np.random.default_rng(bits)
    texts = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 63, 64, 500, 3, 129)]
    sink = io.BytesIO()
    writer = bitpack.Writer(sink, bits, block_ids=128)
    for i, ids in enumerate(texts):
        writer.add(i if i else None, ids)
    writer.close()
    file = pa.BufferReader(sink.getvalue())
    index = bitpack.read_index(file)
    assert index.doc_ids == [None, 1, 2, 3, 4, 5, 6]
    for i, got in enumerate(bitpack.documents(file, index)):
        assert got.tolist() == texts[i].tolist() == bitpack.read_document(file, index, i).tolist()


def test_token_files(docs, empty):
    library = Tokenizer.from_file(BYTES)
    found = bitpack.packed_documents(docs, BYTES).collect()
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found if r.doc_id is not None)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows()]
    assert sorted((i, ids) for _, i, ids in got) == sorted(w for w in want if w[0] is not None)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    assert [i for _, i, _ in got] == sorted(i for _, i, _ in got)
    assert bitpack.packed_documents(empty, BYTES).collect() == []


def test_encoder_takes_single_pre_tokens_to_the_model(monkeypatch):
    texts = [" ".join(f"{w}{x}{m}" for m in ("", ",", '..."')) for w in ("plain", "Émile", "ſt") for x in ("er", "éa\nno")]
    coder, asked = bitpack.Encoder(BYTES), []
    whole_call = coder.library
    monkeypatch.setattr(coder, "library", lambda some: (asked.extend(some), whole_call(some))[1])
    want = [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in coder.encode(texts)] == want
    assert set(asked) == {t.split(" ")[0] for t in texts}


def test_encoder_equals_the_library_when_it_forgets(monkeypatch):
    monkeypatch.setattr(bitpack, "REMEMBERED", 40)
    monkeypatch.setattr(bitpack, "REMEMBERED_PARTS", 20)
    rng, coder = random.Random(4), bitpack.Encoder(BYTES)
    bits = ["the", "Hello", " ", "  ", "\n", "\t", "don't", "a.", "--", "1", "12x", "é", "日本", "<|endoftext|>", "",
            "word,\nnext", "\r\n", "'s", " \n", "\n\ny", "\u00a0", "\u3000x", "\x1f", "×", "Ā!"]
    for _ in range(100):
        texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(8)]
        want = [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in coder.encode(texts)] == want


@pytest.mark.parametrize(("keep", "copies"), [("smallest", 1000), ("largest", 1000), ("largest", 1)])
def test_exact_groups(docs, empty, monkeypatch, keep, copies):
    monkeypatch.setattr(content_sort, "HOT_COPIES", copies)
    lowered = str.maketrans(content_sort.whole.__globals__["UPPER"], content_sort.whole.__globals__["UPPER"].lower())
    groups: dict[str, list] = {}
    for i, t, *_ in rows():
        groups.setdefault((t or "").translate(lowered), []).append(i)
    best = {n: (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None)
            for n, ids in groups.items()}
    want = Counter(
        (i, hashlib.sha256(n.encode()).hexdigest(), best[n], len(ids)) for n, ids in groups.items() for i in ids)
    found = content_sort.grouped(docs, keep)
    assert counted(found, "doc_id", "text_sha256", "keep_id", "group_size") == want
    kept = [(r.text_sha256, r.doc_id) for r in found.collect() if r.kept]
    assert sorted(kept) == sorted((hashlib.sha256(n.encode()).hexdigest(), b) for n, b in best.items())
    one = content_sort.keep_one(docs, keep)
    assert one.columns == docs.columns and one.count() == len(groups)
    assert content_sort.grouped(empty, keep).collect() == []


def test_mixing_equals_sql(docs, empty):
    con = duckdb.connect()
    con.register("given", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM given")
    assert_same(mixing.mix(docs), con, queries.MIXING_SQL)
    assert mixing.mix(empty).collect() == [] and mixing.training_order(empty).collect() == []


def test_training_order_holds_whole_documents_near_the_targets(docs):
    """Also of NULL and repeated ids, with clashing column names; no text is cut."""
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    got = Counter(tuple(r) for r in ordered.collect())
    assert set(got) <= {tuple(r) for r in rows()}
    words, most, target = Counter(), Counter(), {}
    for row, times in got.items():
        words[row[3]] += times * len((row[1] or "").encode().split())
    for r in docs.collect():
        most[r.source] = max(most[r.source], len((r.text or "").encode().split()))
    for r in mixing.mix(docs).collect():
        source = next(x[3] for x in rows() if x[0] == r.doc_id and len((x[1] or "").encode().split()) == r.size)
        target[source] = r.target
    assert len(target) > 1
    for source, wanted in target.items():
        assert abs(words[source] - wanted) <= most[source] / 2 + 1
    empty_texts = sum(times for row, times in got.items() if not (row[1] or "").split())
    assert empty_texts == sum(not (x[1] or "").split() for x in rows())


def test_mix_of_documents_without_words(spark):
    blank = spark.createDataFrame([(i, t, "a") for i, t in enumerate(["", None, " ", "\n"])], "doc_id long, text string, source string")
    found = mixing.mix(blank).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in found] == [(0, 0, 0.0, 0)] * 4
    assert mixing.training_order(blank).count() == 4


def test_chat_keeps_maximal_conversations(spark):
    def talk(conv, *turns):
        return [(conv, n, role, text) for n, (role, text) in enumerate(turns)]

    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", None)
    given = talk(1, a) + talk(2, a, b) + talk(3, a, b, c) + talk(4, a, b, c) + talk(5, b) + talk(6, a, b, ("user", ""))
    given += [(None, 0, "user", "alone"), (7, 0, None, None), (7, 0, None, None)]
    turns = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.n_turns, r.rendered) for r in chat.chat_documents(turns).collect()}
    assert set(found) == {3, 5, 6, 7, None}
    assert found[3] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
                           "<|im_start|>user\n<|im_end|>\n")
    assert chat.chat_documents(turns.limit(0)).collect() == []


def test_quality_rules_by_brute_force(docs, empty):
    bands, packer = compression_bands.Bands(), zstandard.ZstdCompressor(level=3)

    def verdict(text):
        words = text.encode().split()
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        failed = len(words) < 50 or 2 * len(again) > len(words)
        return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed

    found = compression_bands.judge(docs)
    names = (*compression_bands.FIELDS, "base_failed")
    assert counted(found, "doc_id", *names) == Counter((i, *verdict(t or "")) for i, t, *_ in rows())
    for text, good in ((PROSE * 40, False), (random.Random(3).randbytes(4000).hex(), True), ("", True)):
        *_, inside = compression_bands.ratios(text.encode(), packer, bands)
        assert inside == good
    kept = compression_bands.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == found.filter("kept").count()
    assert compression_bands.judge(empty).collect() == []


def test_bands_tell_noise_and_templates_from_prose():
    """All of these pass the base rules; the bands alone decide."""
    bands, packer, rng = compression_bands.Bands(), zstandard.ZstdCompressor(level=3), random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def passes(text):
        words, *_, repeated = compression_bands.text_counts(text)
        return words >= 50 and 2 * repeated <= words

    def inside(text):
        return compression_bands.ratios(text.encode(), packer, bands)[-1]

    def noise(alphabet, size):
        return " ".join("".join(rng.choices(alphabet, k=12)) for _ in range(size // 13))

    junk = [noise(a, n) for a in (letters, letters + "0123456789+/") for n in (700, 1500, 3000, 7000, 20_000, 50_000)]
    junk += [noise(letters[:26], n) for n in (3000, 7000, 20_000, 50_000)]
    junk += ["\n".join(f"Row {i} value {i * 7 % 997}" for i in range(n)) for n in (60, 200, 800)]
    assert all(map(passes, junk)) and not any(map(inside, junk))
    clean = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()
    clean = [t for (t,) in clean if passes(t)]
    assert len(clean) > 800 and all(map(inside, clean))
    # A third of noise in a text of three chunks.
    prose = next(t for t in clean if len(t.encode()) > 5000)[:4000]
    assert not inside(prose + noise(letters + "0123456789+/", 2000))


def components_of(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = top(i), top(j)
                low[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("crowd, paired", [(1, 8), (10**6, 8), (2, 1_000)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, crowd, paired):
    monkeypatch.setattr(prefix_join, "HOT_ROWS", 5)
    monkeypatch.setattr(prefix_join, "CROWD", crowd)
    monkeypatch.setattr(prefix_join, "PAIRED_ROWS", paired)
    rng = random.Random(7)
    texts = {}
    for family in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(9):
            words = [w if rng.random() > 0.01 else f"v{rng.randrange(999)}" for w in base]
            texts[len(texts)] = " ".join(words)
    texts |= {100: "", 101: None, 102: "one two", 103: "ONE two", 104: texts[0], 105: "\n"}
    given = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(0, texts[0], "x")],
                                  "doc_id long, text string, n string").repartition(5)
    want = components_of({i: t or "" for i, t in texts.items()})
    found = prefix_join.linked(given).collect()
    assert len(found) == len(texts) + 1
    assert {r.doc_id: r.component_id for r in found} == want
    empty = prefix_join.linked(given.limit(0))
    assert empty.columns == ["doc_id", "tie", "n_shingles", "component_id"] and empty.collect() == []


def test_one_of_each_component_stays_whatever_its_ids(spark):
    rng = random.Random(8)
    base = {k: [f"{k}{rng.randrange(500)}" for _ in range(90)] for k in "abcde"}

    def near(k, i):
        return " ".join(base[k][:i] + [f"other{i}"] + base[k][i + 1 :])

    given = [(None, near("a", i)) for i in (0, 1, 88, 89)] + [(None, near("a", 0))]  # the last one a copy
    given += [(7, near("b", i)) for i in (0, 1, 89)] + [(7, near("c", i)) for i in (0, 89)]
    given += [(None, near("d", 0)), (3, near("d", 1)), (4, near("d", 2)), (None, near("e", 0)), (None, ""), (None, None)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in prefix_join.keep_one(docs).collect()]
    families = Counter((i, t.split()[5][0] if t else "") for i, t in set(kept))
    assert families == {(None, "a"): 1, (7, "b"): 1, (7, "c"): 1, (3, "d"): 1, (None, "e"): 1, (None, ""): 2}
    assert set(kept) <= set(given) and len(kept) == sum(given.count(k) for k in set(kept))


def test_links_within_a_group(spark):
    """Equal prefix and size, but the leader may be the one that is unlike the other two."""
    tails = {k: [f"{k}{i}" for i in range(200)] for k in "uv"}
    tails["w"] = [*tails["v"][:100], "other", *tails["v"][101:]]
    rows = [(3 * turn + i, " ".join([f"r{turn}x{j}" for j in range(100)] + tails[k]))
            for turn in range(8) for i, k in enumerate("uvw")]
    found = prefix_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {
        d: d - 1 if d % 3 == 2 else d for d, _ in rows}


def test_last_join_pairs_within_the_prefixes_of_both_sizes(spark):
    rule = prefix_join.Similarity()
    # Equal sizes: 36 of 40 shingles must be shared, so 4 of the first 8 of the 12 in a prefix.
    places = {b"a": range(4), b"b": range(2, 6), b"c": range(8, 12), b"d": range(8, 12)}
    split = [(h, name, 40, pos, 1, name) for name, at in places.items() for h, pos in enumerate(at)]
    split += [(h + 100, name, 40, pos, 1, name) for name in (b"c", b"d") for h, pos in enumerate(range(4, 8))]
    split = spark.createDataFrame(split, "h long, set_key binary, n long, pos int, w int, name binary")
    bits = [0] * len(prefix_join.BIT_COLUMNS)
    classes = spark.createDataFrame(
        [(name, 40, k, *bits) for k, name in enumerate(places)],
        "set_key binary, n long, gid long, " + ", ".join(f"{b} long" for b in prefix_join.BIT_COLUMNS))
    label = spark.createDataFrame([], "set_key binary, label binary")
    found = prefix_join.still_apart(split, classes, label, rule).collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in found) == [(b"a", b"b"), (b"c", b"d")]


def test_sets_that_link_meet_in_the_prefixes_of_both_sizes(spark):
    rule, rng, seen = prefix_join.Similarity(), random.Random(6), []
    for case in range(400):
        n = rng.randrange(1, 120)
        one = set(rng.sample(range(300), n))
        two = {x if rng.random() > 0.1 else x + 1000 for x in one} | set(rng.sample(range(300), n // 12))
        if 100 * len(one & two) >= 80 * len(one | two):
            for k, both in enumerate((one, two)):
                seen += [(case, k, x, len(both), pos) for pos, x in enumerate(sorted(both))]
    spark.createDataFrame(seen, "pair int, side int, x int, n long, pos int").createOrReplaceTempView("placed")
    met = spark.sql(f"""
        SELECT l.pair, min(least(l.n, r.n)) AS n, count_if({rule.in_prefix_sql()}) AS k
        FROM placed l JOIN placed r ON l.pair = r.pair AND l.x = r.x AND l.side = 0 AND r.side = 1
        GROUP BY l.pair""").collect()
    assert len(met) > 100
    assert all(r.k >= rule.meets(r.n) for r in met)


def test_wide_signatures_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (40, 64), (64, 65), (500, 620), (3000, 2500)):
        common = rng.integers(0, 2**63, min(n, m) - 1, dtype=np.uint64)
        left, right = (np.unique(np.concatenate([common, rng.integers(0, 2**63, k - len(common), dtype=np.uint64)]))
                       for k in (n, m))
        apart = prefix_join.bits_apart(prefix_join.wide_signature(left), prefix_join.wide_signature(right))
        assert apart <= len(np.setxor1d(left, right))
        assert (apart - len(np.setxor1d(left, right))) % 2 == 0


def test_prefixes_of_similar_sets_meet():
    rng, rule = random.Random(4), prefix_join.Similarity()
    for _ in range(2000):
        base = rng.sample(range(10_000), rng.randrange(1, 120))
        other = [x for x in base if rng.random() > 0.1] + rng.sample(range(10_000, 20_000), rng.randrange(4))
        a, b = set(base), set(other)
        if b and 100 * len(a & b) >= 80 * len(a | b):
            shared = set(sorted(a)[: rule.prefix(len(a))]) & set(sorted(b)[: rule.prefix(len(b))])
            assert len(shared) >= min(rule.meets(len(a)), rule.meets(len(b)))


def test_language_backoff(spark, docs, empty):
    train = spark.createDataFrame(
        [("en", "the house and the garden"), ("de", "das Haus und der Garten"), (None, "le jardin")],
        "lang string, text string")
    model = language_id.learn(train)
    assert model.score("the garden")[0] == "en" and model.score("gartenhaus")[0] == "de"
    assert model.score("12 ½ — !") == ("und", 0.0)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert found[0].lang_pred == found[1].lang_pred == found[16].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.learn(train.limit(0)).score("the") == ("und", 0.0)
    assert language_id.identify(empty, model).collect() == []


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op9_language(spark, SF).filter("held_out").join(docs, "doc_id").filter("lang IS NOT NULL")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count()


def test_language_does_not_depend_on_the_tables_limit(spark, docs, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    texts = [(-1, "gartenhaus zzyzx \u044f\u0449\u0438\u043a" * 3), (-2, None), (None, "qq " * 40), (None, "qq " * 40)]
    given = given.unionByName(spark.createDataFrame([(*t, None) for t in texts], given.schema)).cache()
    training = given.filter("doc_id % 3 != 0")

    def found():
        return counted(language_id.identify(given, language_id.learn(training)), "doc_id", "lang_pred", "score")

    want = found()
    assert sum(want.values()) == given.count()
    monkeypatch.setattr(language_id, "HOT_ROWS", 3)
    for cells in (1, 400, 8000):
        monkeypatch.setattr(language_id, "TABLE_CELLS", cells)
        assert found() == want


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op7_quality(spark, SF).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_discriminant_edges(docs, empty):
    stats = quality_qda.measured(docs)
    for label, score in (("0", 0.0), ("1", 1.0), ("NULL", 0.5)):
        model = quality_qda.fit(stats.selectExpr("stats", f"CAST({label} AS INT) AS label"))
        assert {r.score for r in quality_qda.scored(stats, model).collect()} == {score}
    assert quality_qda.scored(quality_qda.measured(empty), model).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("benchmark", "conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert assert_same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) > 0


def test_encoder_does_not_search_its_strings_for_cycles():
    import gc

    seen = []
    gc.callbacks.append(lambda phase, info: seen.append(phase))
    try:
        coder = bitpack.Encoder(BYTES)
        seen.clear()
        coder.encode([" ".join(f"w{k}x{i}." for i in range(5_000)) for k in range(4)])
        assert seen.count("start") <= 1 and gc.isenabled()  # one may be due when it is on again
    finally:
        gc.callbacks.pop()


def test_codec_remembers_a_bounded_number_of_chunks(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "TEXTS", 2)
    monkeypatch.setattr(sentencepiece_codec, "_known", {})
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(20)) for _ in range(7)]
        found = sentencepiece_codec.encode_texts(texts, PIECES, remembered=50)
        assert [ids.tolist() for ids in found] == library.encode(texts)
        # Two tables of as many chunks, and what a cut of two texts may add to each.
        assert sum(map(len, sentencepiece_codec._known[PIECES])) <= 2 * (50 + 2 * 20)


def test_few_rows_are_shuffled_for_names_and_crowds(spark):
    rule = prefix_join.Similarity()
    rows = [(h, bytes([k]), 40, 0, 1) for k in range(60) for h in (k % 3, 100 + k)]
    rows = spark.createDataFrame(rows, "h long, set_key binary, n long, pos int, w int")
    label = spark.createDataFrame([(bytes([k]), b"x") for k in (3, 4)], "set_key binary, label binary")
    named = prefix_join.labelled(rows, label, rule)
    assert named.columns == [*rows.columns, "name", "band"]
    assert {bytes(r.set_key): bytes(r.name) for r in named.collect()} == {
        bytes([k]): b"x" if k in (3, 4) else bytes([k]) for k in range(60)}
    assert prefix_join.marked(rows, "set_key", label, "set_key").filter("marked").count() == 4
    crowd = prefix_join.crowded_rows(named)
    assert Counter(r.h for r in crowd.collect()) == {0: 20, 1: 20, 2: 20}
    plan = crowd._jdf.queryExecution().toString()
    assert "LeftSemi" not in plan


def test_hot_and_cold_shingles_meet_alike(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "PAIRED_ROWS", 16)
    rng, rule = random.Random(9), prefix_join.Similarity()
    # The first shingles are under 30 classes each, the others under two; sizes below 20 need one in common.
    sets = {bytes([k]): [k % 2, 10 + k // 2, 90 + k % 29] for k in range(60)}
    split = [(h, key, 10, 0, 1, bytes([key[0] % 7])) for key, held in sets.items() for h in held]
    rng.shuffle(split)
    split = spark.createDataFrame(split, "h long, set_key binary, n long, pos int, w int, name binary")
    classes = spark.createDataFrame(
        [(key, 10, key[0], *[0] * len(prefix_join.BIT_COLUMNS)) for key in sets],
        "set_key binary, n long, gid long, " + ", ".join(f"{b} long" for b in prefix_join.BIT_COLUMNS))
    label = spark.createDataFrame([(key, bytes([key[0] % 7])) for key in sets], "set_key binary, label binary")
    found = [(bytes(r.a), bytes(r.b)) for r in prefix_join.still_apart(split, classes, label, rule).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and a[0] % 7 != b[0] % 7 and set(sets[a]) & set(sets[b])}
    assert set(found) == want and len(found) == len(want)


def test_codec_encodes_and_decodes_few_texts_at_a_time(spark, monkeypatch):
    class Watched:
        def __init__(self, processor):
            self.processor, self.encoded, self.decoded = processor, [], []

        def encode(self, texts, **options):
            if isinstance(texts, list):
                self.encoded.append(len(texts))
            return self.processor.encode(texts, **options)

        def decode(self, ids, **options):
            self.decoded.append(len(ids))
            return self.processor.decode(ids, **options)

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    watched = Watched(library)
    monkeypatch.setattr(sentencepiece_codec, "TEXTS", 3)
    monkeypatch.setattr(sentencepiece_codec, "CHUNKS", 8, raising=False)
    monkeypatch.setattr(sentencepiece_codec, "_known", {})
    monkeypatch.setattr(sentencepiece_codec, "library", lambda path: watched)
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(10)] + ["", "é\n\n 日本"]
    run = sentencepiece_codec.codec(PIECES).func
    found = [pa.RecordBatch.from_struct_array(a) for a in run(iter([pa.array(texts), pa.array([], pa.string())]))]
    assert [len(b) for b in found] == [12, 0]
    assert found[0].column("ids").to_pylist() == library.encode(texts)
    assert found[0].column("decoded").to_pylist() == library.decode(library.encode(texts))
    assert max(watched.decoded) <= 3 and max(watched.encoded) <= 8


def test_arrow_gives_memory_back_between_batches(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert [(k, len(given)) for k in common.lean(range(3))] == [(0, 0), (1, 1), (2, 2)] and len(given) == 3


def test_workers_forget_words_after_the_last_pass_over_texts(spark):
    word = "unheardofquux"
    docs = spark.createDataFrame([(1, f"{word} b c d e f")], "doc_id long, text string").repartition(1)
    classes = spark.createDataFrame([(1,)], "sid long")
    assert len(prefix_join.sets_of(docs, classes, prefix_join.Similarity()).collect()) == 1

    def held(batches):
        from cohortry.llm import prefix_join as loaded

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [int(word.encode() in loaded._words)] * len(batch)})

    assert spark.range(0, 800, 1, 16).mapInArrow(held, "n long").agg({"n": "sum"}).first()[0] == 0
