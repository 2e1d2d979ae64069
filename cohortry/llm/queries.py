"""The operators' registered queries over the sample tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import (
    bitpack,
    chat,
    compression_bands,
    content_sort,
    importance,
    language_id,
    mixing,
    prefix_join,
    quality_qda,
    sentencepiece_codec,
    spelling_variants,
    text_density,
    token_counts,
)
from cohortry.llm.common import crc_remainder, shared_folder, stored


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = sentencepiece_codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(coded)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.chat_documents(_table(spark, sf_dir, "conversations"))
    return rendered.select(
        "conv_id", "n_turns", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", *compression_bands.FIELDS, "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.grouped(_table(spark, sf_dir, "documents").select("doc_id", "text"), "largest").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.linked(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stored(quality_qda.measured(docs), shared_folder(spark), "stats")
    stats = stats.withColumn("held_out", crc_remainder("doc_id", 5) == 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_qda.fit(stats.filter("NOT held_out").join(labels, "doc_id"))
    return quality_qda.scored(stats, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bitpack.checksums(bitpack.packed_documents(docs, tokenizer_path("byte_bpe_50k.json")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 4) == 2
    model = language_id.learn(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.main_text(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sentencepiece, op2_mixing, op3_chat, op4_quality_rules, op5_exact_dedup, op6_jaccard_join,
        op7_quality, op8_token_files, op9_language, op10_token_counts, op11_html_text, op12_spelling,
        op13_resampling,
    )
    return {query.__name__: query for query in found}


MIXING_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), per AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][place % 3 + 1] AS weight, [-0.5, 0.0, 0.5][place % 3 + 1]::DOUBLE AS tilt
    FROM per
), left_over AS (
    SELECT a.source, a.source_size, a.weight, a.tilt, a.place,
           (SELECT sum(source_size) FROM weighed) - coalesce(sum(3 * b.source_size), 0) AS rest,
           (SELECT sum(weight) FROM weighed) - coalesce(sum(b.weight), 0) AS weight_rest
    FROM weighed a LEFT JOIN weighed b
      ON (b.source_size * a.weight, b.place) < (a.source_size * b.weight, a.place)
    GROUP BY ALL
), judged AS (
    SELECT *, weight * rest > 3 * source_size * weight_rest AS is_full FROM left_over
), open AS (
    SELECT max(rest) AS rest, max(weight_rest) AS weight_rest FROM judged WHERE NOT is_full
), target AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size, tilt,
           CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(weight * open.rest AS DOUBLE) / CAST(open.weight_rest AS DOUBLE) END AS target
    FROM judged LEFT JOIN open ON true
), quota AS (
    SELECT *, CAST(round(target) AS BIGINT) AS words,
           CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes
    FROM target
), queue AS (
    SELECT doc_id, size, source_size, target, tilt, passes, words - passes * source_size AS rest,
           CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source
), used AS (
    SELECT *, passes * size + least(size, greatest(0, rest - start)) AS taken,
           CAST(start AS DOUBLE) / target AS part
    FROM queue
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0
            THEN 2 * part / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * part)) END AS position
FROM used
"""

CHAT_SQL = r"""
WITH placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id
                                 ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations
), prefixes AS (
    SELECT conv_id, place, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place) AS prefix
    FROM placed
), whole AS (
    SELECT conv_id, max(place) AS n_turns, arg_max(prefix, place) AS prefix FROM prefixes GROUP BY conv_id
), first_ids AS (
    SELECT min(conv_id) AS conv_id, n_turns, prefix FROM whole GROUP BY n_turns, prefix
)
SELECT conv_id, n_turns, sha256(array_to_string([
           '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)
           FOR x IN prefix], '')) AS rendered_sha256
FROM first_ids f
WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p JOIN whole w ON w.conv_id IS NOT DISTINCT FROM p.conv_id
    WHERE p.place = f.n_turns AND p.prefix = f.prefix AND p.place < w.n_turns)
"""

EXACT_SQL = r"""
WITH normalised AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM normalised WINDOW same AS (PARTITION BY norm)
"""


# The crc32 of a text in SQL: a table built from the polynomial, and a fold over the bytes.
CRC_TABLE = """crc_table AS (
    SELECT list(v ORDER BY i) AS crc_of FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, step:
                   CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
        FROM range(256) r(i))
)"""


def _crc32(text: str) -> str:
    """SQL text: the unsigned crc32 of a string's UTF-8 bytes, where ``crc_table`` is joined."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))),
        lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))),
        lambda c, byte: xor(c >> 8, crc_of[(xor(c, byte) & 255) + 1])), 4294967295)"""


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
    SELECT id, run, count(*) AS times FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               {LOWERED.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run
        FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, times, {_crc32("id || ':' || run")} AS h FROM runs, crc_table
), words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % 31 = 0
                      THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), holes AS (
    SELECT word, n, k AS place, left(word, k) || substr(word, k + 2) AS hole
    FROM (SELECT *, unnest(range(length(word))) AS k FROM words)
), pairs AS (
    SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b USING (place, hole) WHERE a.word <> b.word
    UNION SELECT a.word, w.word FROM holes a JOIN words w ON w.word = a.hole
    UNION SELECT w.word, a.word FROM holes a JOIN words w ON w.word = a.hole
), best AS (
    SELECT p.word, count(*) AS n_near, first(p.near ORDER BY w.n DESC, encode(p.near)) AS form, max(w.n) AS form_n
    FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), judged AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
           CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form,
           CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), steps AS (
    SELECT word, word AS at, 0 AS depth FROM judged
    UNION ALL SELECT s.word, j.form, s.depth + 1 FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(s.at, s.depth) FROM steps s WHERE s.word = j.word) AS root, n, n_near, form_n
FROM judged j
"""

RESAMPLING_SQL = rf"""
WITH {CRC_TABLE}, doc_words AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
        {LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), target_words AS (
    SELECT regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), used AS (
    SELECT row_id, word, count(*) AS times FROM (SELECT row_id, unnest(words) AS word FROM doc_words) GROUP BY ALL
), wanted AS (
    SELECT word, count(*) AS times FROM (SELECT unnest(words) AS word FROM target_words) GROUP BY word
), hashed AS (
    SELECT word, {_crc32("word")} % 10000 AS bucket
    FROM (SELECT word FROM used UNION SELECT word FROM wanted), crc_table
), s AS (
    SELECT bucket, sum(times) AS s FROM used JOIN hashed USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, sum(times) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket
), gain AS (
    SELECT bucket, CAST(floor(1000 * ln(
        CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(s) FROM s), 0) + 10000 AS DOUBLE)
        / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(t) FROM t), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM s FULL JOIN t USING (bucket)
), weights AS (
    SELECT row_id, CAST(floor(CAST(sum(times * gain) AS DOUBLE) / sum(times)) AS BIGINT) AS weight
    FROM used JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row_id
), scored AS (
    SELECT d.row_id, d.doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE)
               / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM doc_words d LEFT JOIN weights w USING (row_id)
), ranked AS (
    SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row_id)
"""


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can express; the others are tested against brute force."""
    return {
        "op2_mixing": MIXING_SQL, "op3_chat": CHAT_SQL, "op5_exact_dedup": EXACT_SQL,
        "op12_spelling": SPELLING_SQL, "op13_resampling": RESAMPLING_SQL,
    }
