"""A label dictionary: the raw spellings that a log uses, resolved once to the event classes they mean.

Labels are matched without regard to case, and a filter on ``lower(action)`` cannot reach the Parquet
reader. The distinct raw labels of a log are few, though. One job over the two label columns finds those
that mean anything and gives each a bitmask of its classes. The vocabulary made of them lists raw
spellings, so a filter compares the bare column and reaches the reader, in a log of any casing; and rows
are classified by looking their two labels up instead of testing every class.

A log with more spellings than ``MOST_SPELLINGS`` in a channel is left to ``lower()``: the dictionary is
then not complete, says so, and hands out the folded vocabulary. It describes the log it was made from; for rows
added later, make it again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.vocabulary import VOCABULARY, EventClass, folded, in_list

CHANNELS = {"action": "actions", "page": "pages"}
# Spellings of one channel that a dictionary holds; the list goes into filters and a broadcast.
MOST_SPELLINGS = 2_000
# A bitmask is a long without its sign.
MOST_CLASSES = 63


@dataclass(frozen=True)
class LabelDictionary:
    """``entries`` are (channel, raw label, bitmask) for the classes ``names``, lowest bit first."""

    names: tuple[str, ...]
    entries: tuple[tuple[str, str, int], ...]
    complete: bool
    source: Mapping[str, EventClass]

    @classmethod
    def of(
        cls, activity: DataFrame, vocab: Mapping[str, EventClass] = VOCABULARY, most: int = MOST_SPELLINGS
    ) -> LabelDictionary:
        """One job over the label columns; at most ``most`` + 1 labels a channel reach the driver."""
        if len(vocab) > MOST_CLASSES:
            raise ValueError(f"a dictionary holds {MOST_CLASSES} classes at most")
        meanings: dict[tuple[str, str], int] = {}
        for bit, event_class in enumerate(vocab.values()):
            for channel, spellings in CHANNELS.items():
                for spelling in getattr(event_class, spellings):
                    key = channel, spelling.lower()
                    meanings[key] = meanings.get(key, 0) | 1 << bit
        parts = []
        for channel in CHANNELS:
            wanted = [label for where, label in meanings if where == channel]
            if wanted:
                parts.append(
                    activity.filter(in_list(f"lower({channel})", wanted))
                    .select(F.lit(channel).alias("channel"), F.col(channel).alias("label"),
                            F.lower(channel).alias("folded"))
                    .distinct().limit(most + 1))
        rows = reduce(DataFrame.unionByName, parts).collect() if parts else []
        held = {channel: sum(r["channel"] == channel for r in rows) for channel in CHANNELS}
        complete = max(held.values()) <= most
        entries = sorted((r["channel"], r["label"], meanings[r["channel"], r["folded"]]) for r in rows)
        return cls(tuple(vocab), tuple(entries) if complete else (), complete, vocab)

    def vocabulary(self) -> dict[str, EventClass]:
        """The classes by their raw spellings in this log, for all operators; the folded ones if there
        are too many spellings."""
        if not self.complete:
            return folded(self.source)
        return {
            name: EventClass(
                *(tuple(label for where, label, mask in self.entries if where == channel and mask >> bit & 1)
                  for channel in CHANNELS),
                fold_case=False, exact=True)
            for bit, name in enumerate(self.names)
        }

    def table(self, spark: SparkSession) -> DataFrame:
        """``channel``, ``label`` and the ``classes`` bitmask, a row a raw label."""
        return spark.createDataFrame(list(self.entries), "channel string, label string, classes long")

    def classes(self, activity: DataFrame) -> DataFrame:
        """The log with the bitmask ``classes`` of each event; of a complete dictionary."""
        entries = self.table(activity.sparkSession)
        for channel in CHANNELS:
            # Two thousand labels a channel at most.
            found = F.broadcast(entries.filter(F.col("channel") == channel).select(
                F.col("label").alias(channel), F.col("classes").alias(f"{channel}_classes")))
            activity = activity.join(found, channel, "left")
        either = " | ".join(f"coalesce({channel}_classes, 0L)" for channel in CHANNELS)
        return activity.withColumn("classes", F.expr(either)).drop(*(f"{c}_classes" for c in CHANNELS))

    def classify(self, activity: DataFrame, only: list[str] | None = None) -> DataFrame:
        """The log with one boolean column ``is_<class>`` per class, by two lookups a row."""
        names = list(self.names) if only is None else only
        if not self.complete:
            vocab = self.vocabulary()
            flags = [F.coalesce(vocab[n].hit(), F.lit(False)).alias(f"is_{n}") for n in names]
            return activity.select("*", *flags)

        def has(name: str) -> Column:
            return (F.col("classes").bitwiseAND(F.lit(1 << self.names.index(name))) != 0).alias(f"is_{name}")

        return self.classes(activity).select(*activity.columns, *map(has, names))
