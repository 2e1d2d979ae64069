"""Mixing sources to target weights on a time-varying curriculum (operator 2), DataFrame functions only.

Training time runs from 0 to 1. Every source has a weight that changes linearly over that time; the
integral of its weight is its share of all words. Shares stop at a multiple of the source's size; the
rest is shared anew by weight. The cumulative demand of a source, integrated up to a time, says how
many of its words have been used by then. Its documents wait in a fixed pseudo-random order, over as
many passes as needed, and each is placed at the time when demand reaches its first word: the
inverse of the cumulative demand. Sorting by that time gives the training order.

Sizes are word counts (NULL text: 0). A NULL source is a source of its own, last in the order.
Repeated rows are separate documents; rows alike in id, size and text are interchangeable. A source
without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import WORD, shared_folder, stored, whole

# Rows of the waiting order that make a bucket, on average over all documents.
BUCKET_ROWS = 50_000
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Curriculum:
    """Weights of the sources in order of name, repeating, and how they change.

    Over time t a weight is ``weight * (1 + tilt * (2 t - 1))``: a negative tilt is heavier at the
    start, and the mean stays the weight. Tilts lie between -1 and 1. No source gives more than
    ``most`` times its size.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    tilts: tuple[float, ...] = (-0.5, 0.0, 0.5)
    most: int = 3


def _repeating(values: tuple, place: str) -> Column:
    """The value at a place, counted from 0, of a list that repeats."""
    at = F.pmod(F.col(place), F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, values)), at)


def source_targets(per_source: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """``source``, ``source_size``, ``target`` words and ``tilt`` from one (source, size) row each.

    With sources sorted by limit per weight, those that stop at their limit come first; whole-number
    running sums decide which, without iterating. The windows run over one row per source.
    """
    common = lcm(*plan.weights)
    zero = F.lit(0).cast(EXACT)
    by_name = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = (F.col("source_size").cast(EXACT) * plan.most).cast(EXACT)
    per = per_source.withColumn("place", by_name).select(
        "source", "source_size", "place", limit.alias("limit"),
        _repeating(plan.tilts, "place").alias("tilt"),
        _repeating(plan.weights, "place").cast(EXACT).alias("weight"),
        # Limit per weight, times the weights' common multiple: a whole number.
        (limit * _repeating(tuple(common // w for w in plan.weights), "place")).alias("fills"))
    sooner = Window.orderBy("fills", "place")
    before = sooner.rowsBetween(Window.unboundedPreceding, -1)
    every = sooner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*", F.row_number().over(sooner).alias("nth"),
        (F.sum("source_size").over(every).cast(EXACT)
         - F.coalesce(F.sum("limit").over(before).cast(EXACT), zero)).cast(EXACT).alias("left"),
        (F.sum("weight").over(every).cast(EXACT)
         - F.coalesce(F.sum("weight").over(before).cast(EXACT), zero)).cast(EXACT).alias("weight_left"))
    # A source is full when its share of what the fuller ones leave exceeds its limit.
    per = per.withColumn("full", F.col("weight") * F.col("left") > F.col("limit") * F.col("weight_left"))
    first_open = F.min(F.when(~F.col("full"), F.struct("nth", "left", "weight_left"))).over(every)
    per = per.withColumn("open", first_open)
    shared = (F.col("weight") * F.col("open.left")).cast("double") / F.col("open.weight_left").cast("double")
    return per.select(
        "source", "source_size", "tilt",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def sizes(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id``, ``source``, ``size``, the place in the waiting order and, on request, the row."""
    text = whole("text")
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"),
        F.xxhash64(text).alias("tie"), *row)


def placed(sized: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """Every document with its source's target and the words the mix takes from it.

    Adds ``source_size``, ``target``, ``tilt``, ``taken``, ``passes`` (whole passes over the source),
    ``start`` (words of the source that wait before it) and ``rest`` (words that the pass after the
    whole ones takes). A source of any size is cut into buckets of its waiting order; sums per bucket
    make the running sum, so no task sees a whole source.
    """
    digits, rows = 1, sized.count()
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    # Text that tells a NULL source from all others.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    keyed = sized.withColumns({"key": key, "bucket": F.substring("turn", 1, digits)})
    buckets = keyed.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(
        buckets.groupBy("source").agg(F.sum("words").alias("source_size")), plan)
    targets = targets.withColumns({
        "key": key, "quota": F.round("target").cast("long"),
        "passes": F.expr("if(source_size > 0, CAST(round(target) AS BIGINT) div source_size, 0)"),
    }).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        "key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier")
    ).join(targets.drop("source", "quota"), "key")
    waiting = Window.partitionBy("key", "bucket").orderBy("turn", "doc_id", "size", "tie")
    ahead = waiting.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("earlier") + F.coalesce(F.sum("size").over(ahead), F.lit(0))
    last_pass = F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    return (
        keyed.join(buckets, ["key", "bucket"]).withColumn("start", start)
        .withColumn("taken", F.col("passes") * F.col("size") + last_pass)
        .drop("key", "bucket", "earlier", "turn", "tie")
    )


def demand_time(words: str, target: str = "target", tilt: str = "tilt") -> str:
    """SQL text: the time at which a source's cumulative demand reaches a number of words.

    The demand up to time t is ``target * ((1 - tilt) t + tilt t^2)``; this is its inverse.
    """
    part, flat = f"(CAST({words} AS DOUBLE) / {target})", f"(1 - {tilt})"
    return f"(2 * {part} / ({flat} + sqrt({flat} * {flat} + 4 * {tilt} * {part})))"


def mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """One row per document, sorted by the time of its first use: ``doc_id``, ``size``,
    ``source_size``, ``target``, ``taken`` and ``position`` (NULL when nothing is taken)."""
    sized = stored(sizes(docs), shared_folder(docs.sparkSession), "sizes")
    first = F.expr(f"CASE WHEN taken > 0 THEN {demand_time('start')} END")
    found = placed(sized, plan).select(
        "doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return found.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The mixed corpus: each document once for every pass that takes it, in training order.

    Rows are those of ``docs``, whole and unchanged. The one document of a source that the last pass takes
    in part comes if that pass takes half of its words or more, so a source's words differ from its target
    by half a document at most. Documents without words come once.
    """
    uses = placed(sizes(docs, carry=True), plan).withColumn(
        "pass", F.explode(F.expr("sequence(0, CAST(passes AS INT))")))
    words = F.expr("if(pass < passes, size, least(size, greatest(0, rest - start)))")
    comes = "words > 0 AND 2 * words >= size OR size = 0 AND pass = 0"
    used = uses.withColumn("words", words).filter(comes)
    at = F.expr(f"if(words > 0, {demand_time('(pass * source_size + start)')}, 0D)")
    ordered = used.select("row", "doc_id", "pass", at.alias("position")).repartitionByRange(
        "position", "doc_id").sortWithinPartitions("position", "doc_id", "pass")
    return ordered.select(*(F.col("row").getField(name).alias(name) for name in docs.columns))
