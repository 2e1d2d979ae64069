"""Exact duplicates by sorting contents (operator 5), in DataFrame functions only.

Rows are range-partitioned by sampled splitters over their normalised text, sorted within each
partition by external sorting, and grouped where neighbours agree byte for byte. The range key is
the text's first characters and a hash of all of it, so that splitters stay short; the sort compares
whole texts. A text with very many copies gets a salt behind its key: its rows spread over several
partitions, and its copies are counted by a map-side aggregation instead.

Texts are equal when identical after lower-casing A-Z; NULL counts as empty. Of rows tied on the kept
id (repeated rows, or NULL ids only) exactly one is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import ascii_lower, whole

# A text is hot from this many copies on; there are never more hot texts than HOT_TEXTS.
HOT_COPIES = 1_000
HOT_TEXTS = 10_000
# Characters of the range key that come from the text itself.
LEAD = 16


def normalised(text: str | Column) -> Column:
    """The text with A-Z lower-cased. All-ASCII texts take the faster function, to the same end."""
    value = whole(text)
    ascii_only = F.octet_length(value) == F.char_length(value)
    return F.when(ascii_only, F.lower(value)).otherwise(ascii_lower(value))


def grouped(docs: DataFrame, keep: str = "smallest", text: str = "text") -> DataFrame:
    """One row per document: the document as ``row``, its text's digest, and its group.

    Columns: ``row``, ``doc_id``, ``text_sha256``, ``keep_id``, ``group_size``, ``kept``. ``keep`` is
    'smallest' or 'largest': which id stays.
    """
    best, order = (F.min, F.col("doc_id").asc_nulls_last()) if keep == "smallest" else (
        F.max, F.col("doc_id").desc_nulls_last())
    # Equal texts are equal in lower case too: a coarser key, cheap to compute.
    folded = F.lower(whole(text))
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id",
        F.substring(folded, 1, LEAD).alias("lead"), F.xxhash64(folded).alias("code"))
    copies = max(HOT_COPIES, -(-docs.count() // HOT_TEXTS))
    hot = (
        keyed.groupBy("code").agg(F.count("*").alias("rows")).filter(F.col("rows") > copies)
        .select("code", F.ceil(F.col("rows") / copies).cast("int").alias("fan"))
    )
    # Fewer than rows / copies codes can be hot: at most HOT_TEXTS rows of two numbers.
    hot = F.broadcast(hot)
    spread = keyed.join(hot, "code", "left").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("fan", F.lit(1))))
    placed = spread.repartitionByRange("lead", "code", "salt").withColumn(
        "norm", normalised(F.col("row").getField(text)))
    equal = Window.partitionBy("lead", "code", "salt", "norm").orderBy(order)
    everyone = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = placed.select(
        "row", "doc_id", "fan", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.row_number().over(equal).alias("nth"),
        best("doc_id").over(everyone).alias("local_keep"),
        F.count("*").over(everyone).alias("local_size"))
    # Salted groups: totals from partial aggregates, a row per hot text and map task.
    total = (
        keyed.join(hot, "code").groupBy(normalised(F.col("row").getField(text)).alias("norm"))
        .agg(best("doc_id").alias("hot_keep"), F.count("*").alias("hot_size"))
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "hot_keep", "hot_size")
    )
    keep_id = F.when(F.col("hot_size").isNull(), F.col("local_keep")).otherwise(F.col("hot_keep"))
    return local.join(F.broadcast(total), "text_sha256", "left").select(
        "row", "doc_id", "text_sha256", keep_id.alias("keep_id"),
        F.coalesce("hot_size", "local_size").alias("group_size"),
        # Equal ids share a salt, so the first row that holds the kept id is one row only.
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"))


def keep_one(docs: DataFrame, keep: str = "smallest", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and nothing else."""
    return grouped(docs, keep, text).filter("kept").select("row.*")
