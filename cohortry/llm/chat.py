"""Chat formatting with cumulative-snapshot collapse (operator 3).

Chat logs often hold one conversation several times, each snapshot longer than the one before. Every
turn gets a hash of all turns up to it: the exclusive or of hashes of (place, role, text), so it rolls
along an ordinary running window. A conversation whose last hash equals the hash of an inner turn of
another is a prefix of that one and leaves by an anti-join; of equal conversations the smallest id
stays. What is left is rendered with a chat template.

Turns are ordered by ``turn``, then role and text, NULLs first; NULL roles and texts render as empty,
but differ from empty ones when conversations are compared. Repeated rows are separate turns. A NULL
``conv_id`` is one conversation like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import shared_folder, stored, whole


@dataclass(frozen=True)
class Template:
    """Text around a turn; the role stands between ``start`` and ``middle``."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """The turns with their ``place`` and the two 64-bit hashes of everything up to them."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select(
        "conv_id", "role", "text", F.row_number().over(order).alias("place"))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def rolling(seed: int) -> Column:
        parts = [F.lit(seed), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
        return F.bit_xor(F.xxhash64(*parts)).over(so_far)

    return placed.withColumns({"h1": rolling(1), "h2": rolling(2)})


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that are no prefix of another one."""
    hashed = stored(prefix_hashes(turns).drop("role", "text"), shared_folder(turns.sparkSession), "prefixes")
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end"))
    # Inner turns: their hash with their place occurs in a longer conversation. Common first turns
    # collapse to one row before the shuffle.
    last = ends.select(F.col("conv_id").alias("c"), F.col("end.place").alias("n"))
    inner = hashed.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") < F.col("n")))
    inner = inner.groupBy("place", "h1", "h2").agg(F.count("*").alias("rows")).drop("rows")
    own = ends.groupBy("end").agg(F.min("conv_id").alias("conv_id"))
    return own.select("conv_id", "end.place", "end.h1", "end.h2").join(
        inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"))


def render(turns: DataFrame, chosen: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` of the chosen conversations."""
    line = F.concat(F.lit(template.start), whole("role"), F.lit(template.middle), whole("text"), F.lit(template.end))
    kept = chosen.select(F.col("conv_id").alias("c"), "n_turns")
    rows = turns.select("conv_id", "turn", "role", "text", line.alias("line")).join(
        kept, F.col("conv_id").eqNullSafe(F.col("c")))
    # array_sort compares field by field with NULLs last; the flags put them first, as above.
    turn = F.struct(
        F.col("turn").isNotNull().alias("a"), "turn", F.col("role").isNotNull().alias("b"), "role",
        F.col("text").isNotNull().alias("c"), "line")
    lines = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["line"])
    return rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.array_join(lines, "").alias("rendered"))


def chat_documents(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """The maximal conversations as text."""
    return render(turns, maximal(turns), template)
