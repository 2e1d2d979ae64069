"""Near duplicates by a grouped prefix join on word shingles (operator 6).

Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles is 0.8 or
more. With all shingles in one global order, rare ones first, sets that similar share at least k shingles
among the first ``n - ceil(0.8 n) + k`` of each: the prefix. Here k is 4, and 1 for sets below 20.

1. A counting pass over all documents fills a table of fixed size with the document frequencies of
   hashed shingles; it orders the shingles.
2. Documents with equal sets become one class; classes with identical prefix and size one group.
3. Groups that share a prefix shingle are paired: each with one centre of like size per shingle, not
   with each other. Group pairs are filtered by size and stand for their leaders only; members pair
   with their own leader. Pairs whose bit signatures already differ too much go, and the rest is
   verified on whole sets.
4. Links found so far form components. Classes that share a crowded shingle and are still apart are
   paired with further centres.
5. Groups still apart, cut by component, are paired on the shingles they share that lie in the pair's
   own prefixes, which are shorter the closer the two sizes are, and filtered by size, by the number of
   such shingles, and by signature where they hold one class; group pairs that stay
   expand to their members, which are verified. So all pairs that share k prefix shingles and could
   link are verified or lie within one component, and no link between components is lost.

A shingle of very many documents is spread over several tasks by a salt, from the counts up to the
centres of step 3, from its own rows in step 5.

Words are runs of anything but the six blanks, A-Z in lower case. Fewer than five words make one
shingle; documents without words or text have an empty set, link with nothing and keep their own id.
NULL ids count as larger than all others. Repeated rows share a class. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import lean, prepare, release, shared_folder, stored, whole
from cohortry.llm.components import components

# Frequency table: 2^18 counters, a fixed 2 MB.
TABLE_BITS = 18
# Rows of one shingle that go to one task.
HOT_ROWS = 50_000
# Bits of a signature.
SIGNATURE = 512
# Bits of the table that tells which documents' sets are needed.
FILTER_BITS = 24
# Words and groups that a task remembers.
REMEMBERED = 200_000
# A shingle with more rows than this is crowded: its classes meet centres before they meet each other.
CROWD = 8
# Centres that a crowded shingle has in a round.
CENTRES = 4
# A round of centres is worth another one if it finds a link for so many of its pairs.
LINKS_WORTH = 20
MOST_STAR_ROUNDS = 2
# Units of one shingle that a task pairs with all others of it.
PAIRED_ROWS = 1_000


@dataclass(frozen=True)
class Similarity:
    """Link when ``100 * intersection >= percent * union`` over shingles of ``words`` words."""

    words: int = 5
    percent: int = 80

    def meets(self, n: int) -> int:
        """Prefix shingles that a set of n shares with any set it links with, at least."""
        return 4 if n >= 20 else 1

    def prefix(self, n: int) -> int:
        """Length of the prefix of a set of n."""
        return min(n, n - -(-n * self.percent // 100) + self.meets(n))

    def meets_sql(self, n: str) -> str:
        return f"if({n} >= 20, 4, 1)"

    def overlap_sql(self, left: str, right: str) -> str:
        """Shingles that sets of these sizes share, at least, if they link."""
        whole_part = 100 + self.percent
        return f"(({self.percent} * ({left} + {right}) + {whole_part - 1}) div {whole_part})"

    def in_prefix_sql(self, left: str = "l", right: str = "r") -> str:
        """The shingle of two postings lies in the prefixes that the two sizes need.

        Sets that share o shingles share k among the first ``n - o + k`` of each; the prefix of a set
        serves the smallest o, that of a pair the o of its sizes.
        """
        most = f"{self.meets_sql(f'least({left}.n, {right}.n)')} - {self.overlap_sql(f'{left}.n', f'{right}.n')}"
        return f"{left}.pos < {left}.n + {most} AND {right}.pos < {right}.n + {most}"

    def tells_apart_sql(self, n: str) -> str:
        """Unlike sets of n seldom pass as alike by their signatures, which differ in half of the bits."""
        return f"{2 * (100 - self.percent)} * {n} < {(100 + self.percent) * (SIGNATURE // 2 + SIGNATURE // 16)}"

    def band_sql(self, n: str) -> str:
        """Number of the size band; sets that link lie in the same or in neighbouring bands."""
        return f"CAST(floor(ln({n}) / ln({100 / self.percent})) AS INT)"


class _Hashes(dict):
    """Hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Hashes()


def forget_words() -> None:
    """Lets go of the words of a worker, which lives on for other stages."""
    _words.clear()


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return np.array([], dtype=np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    hashes = np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)
    size = min(size, len(words))
    count = len(words) - size + 1
    with np.errstate(over="ignore"):
        value = np.full(count, size, dtype=np.uint64)
        for k in range(size):
            value = value * _FACTOR + hashes[k : k + count]
        # Spread the bits: the order among equal counts should not depend on the words.
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(29)
    return np.unique(value)


def signature(shingles: np.ndarray) -> bytes:
    """Parity of the set in each of ``SIGNATURE`` hashed places: two sets differ in at least as many
    elements as their signatures in bits."""
    place = (shingles % np.uint64(SIGNATURE)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=SIGNATURE).astype(np.uint8) & 1).tobytes()


def wide_signature(shingles: np.ndarray) -> bytes:
    """The same with one to two places for each element, so that it also tells long sets apart."""
    places = 1 << max(6, (len(shingles) - 1).bit_length())
    place = (shingles % np.uint64(places)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=places).astype(np.uint8) & 1).tobytes()


def bits_apart(left: bytes, right: bytes) -> int:
    """Bits in which two wide signatures differ; the longer one is folded to the length of the other."""
    one, two = sorted((np.frombuffer(x, dtype=np.uint8) for x in (left, right)), key=len)
    folded = np.bitwise_xor.reduce(two.reshape(-1, len(one)), axis=0)
    return int(np.unpackbits(one ^ folded).sum())


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def frequencies(docs: DataFrame, rule: Similarity, text: str | Column = "text") -> np.ndarray:
    """Documents per hashed shingle, over all documents; a task sends one table at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        for batch in lean(batches):
            for t in batch.column(0).to_pylist():
                np.add.at(table, _slot(shingle_set(t, rule.words)), 1)
        used = np.flatnonzero(table)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(table[part])], names=["slot", "n"])

    rows = docs.select(whole(text).alias("t")).mapInArrow(count, "slot int, n bigint")
    found = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # no row objects in the driver
    table = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def order_and_fans(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each counter its place in the global order, rare first, and the salts of its shingles."""
    counts, place = np.unique(table, return_inverse=True)
    level = (place * 65535 // max(len(counts) - 1, 1)).astype(np.uint16)
    # What a counter holds beyond the mean is owed to single frequent shingles.
    beyond = table - int(table.mean())
    fans = np.where(beyond > 3 * table.mean() + HOT_ROWS, -(-beyond // HOT_ROWS), 1)
    return level, fans.astype(np.int32)


BIT_COLUMNS = [f"b{i}" for i in range(SIGNATURE // 64)]
PROFILE = (
    "doc_id bigint, tie bigint, n bigint, set_key binary, gid bigint, prefix array<bigint>, fan array<int>, "
    + ", ".join(f"{b} bigint" for b in BIT_COLUMNS))


def profiles(docs: DataFrame, rule: Similarity, text: str | Column = "text") -> DataFrame:
    """One row per document: size and key of its set, group key, prefix, signature.

    A task that has already given a group's prefix leaves it out for the group's next documents.
    """
    order = docs.sparkSession.sparkContext.broadcast(order_and_fans(frequencies(docs, rule, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        level, fans = order.value
        given: set[int] = set()
        for batch in lean(batches):
            sizes, keys, groups, prefixes, salts, bits = [], [], [], [], [], []
            for t in batch.column(2).to_pylist():
                found = shingle_set(t, rule.words)
                n = len(found)
                sizes.append(n)
                if not n:
                    for column in (keys, groups, prefixes, salts):
                        column.append(None)
                    bits.append(bytes(SIGNATURE // 8))
                    continue
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                bits.append(signature(found))
                slot = _slot(found)
                # Sorted by hash already: a stable sort by level gives one order for all sets.
                first = np.argsort(level[slot], kind="stable")[: rule.prefix(n)]
                prefix = found[first]
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n) - (1 << 63)
                groups.append(group)
                if group in given:
                    prefixes.append(None)
                    salts.append(None)
                else:
                    if len(given) > REMEMBERED:
                        given.clear()
                    given.add(group)
                    prefixes.append(prefix.view(np.int64))
                    salts.append(fans[slot[first]])
            words = np.frombuffer(b"".join(bits), dtype="<i8").reshape(len(sizes), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(salts, pa.list_(pa.int32())), *map(pa.array, np.ascontiguousarray(words.T))],
                names=["doc_id", "tie", "n", "set_key", "gid", "prefix", "fan", *BIT_COLUMNS])

    return docs.select("doc_id", F.xxhash64(whole(text)).alias("tie"), whole(text).alias("t")).mapInArrow(run, PROFILE)


def shared_postings(profile: DataFrame, rule: Similarity) -> DataFrame:
    """(shingle ``h``, group ``gid``, centre ``c``, ``fan``, place ``pos``) of prefix shingles that several
    groups may share.

    The centre is the smallest group of like size with the shingle, or with its salt.
    """
    postings = profile.filter("prefix IS NOT NULL").select(
        "gid", "n", F.posexplode(F.arrays_zip("prefix", "fan")).alias("pos", "p")).select(
        F.col("p.prefix").alias("h"), "gid", "n", "pos", F.col("p.fan").alias("fan"),
        F.when(F.col("p.fan") > 1, F.pmod("gid", F.col("p.fan"))).otherwise(F.lit(0)).alias("salt"))
    # A partner of like size exists only if the next smaller or larger set is one.
    by_size = Window.partitionBy("h", "salt").orderBy("n")
    near = postings.select("*", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"))
    near = near.filter(f"100 * below >= {rule.percent} * n OR 100 * n >= {rule.percent} * above OR fan > 1")
    alike = Window.partitionBy("h", "salt", "band")
    return near.withColumn("band", F.expr(rule.band_sql("n"))).select(
        "h", "gid", "n", "pos", "fan", F.min("gid").over(alike).alias("c"))


def enough(postings: DataFrame, rule: Similarity) -> DataFrame:
    """The postings of groups that share as many shingles as a link takes with any partner's size."""
    # The smallest partner of a set of n has percent / 100 * n shingles.
    least = rule.meets_sql(f"{rule.percent} * n / 100")
    groups = postings.groupBy("gid").agg(F.count("*").alias("k"), F.min("n").alias("n")).filter(f"k >= {least}")
    return postings.join(groups.select("gid"), "gid", "left_semi")


def set_classes(profile: DataFrame) -> DataFrame:
    """One row per distinct set: key, size, group, smallest document id, signature."""
    return profile.filter("n > 0").groupBy("set_key", "n", "gid").agg(
        F.min("doc_id").alias("sid"), *(F.min(b).alias(b) for b in BIT_COLUMNS))


def marked(rows: DataFrame, key: str, ids: DataFrame, column: str) -> DataFrame:
    """The rows with ``marked``: their ``key`` is among the ids, or one of few others.

    The ids fill a bit table of fixed size, kept as words of 64 bits: at most 2^18 rows of two
    numbers, which is what is broadcast. When more ids come than the table can tell apart it marks
    more rows; it never misses one.
    """
    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))

    words = ids.select(slot(column).alias("slot")).selectExpr(
        "shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit"
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = rows.withColumn("slot", slot(key)).withColumn("word", F.expr("shiftright(slot, 6)"))
    bit = "(shiftright(coalesce(bits, 0L), CAST(slot % 64 AS INT)) & 1L) = 1L"
    return placed.join(F.broadcast(words), "word", "left").withColumn("marked", F.expr(bit)).drop("slot", "word", "bits")


def likely_members(rows: DataFrame, key: str, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``key`` is among the ids, and few others."""
    return marked(rows, key, ids, column).filter("marked").drop("marked")


def sets_of(docs: DataFrame, classes: DataFrame, rule: Similarity, text: str | Column = "text") -> DataFrame:
    """``set_key``, size, wide signature and sorted set of at least the given classes, from their
    smallest document ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        given: set[bytes] = set()  # repeated rows: a task sends a set once
        for batch in lean(batches):
            sets, keys, sizes, wide = [], [], [], []
            for t in batch.column(0).to_pylist():
                shingles = shingle_set(t, rule.words)
                found = shingles.tobytes()
                key = xxhash.xxh3_128_digest(found)
                if key not in given:
                    if len(given) > REMEMBERED:
                        given.clear()
                    given.add(key)
                    sets.append(found)
                    keys.append(key)
                    sizes.append(len(shingles))
                    wide.append(wide_signature(shingles))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()),
                 pa.array(sets, pa.binary())], names=["set_key", "n", "wide", "shingles"])
        forget_words()  # these are the last tasks that read texts

    rows = likely_members(docs.select("doc_id", whole(text).alias("t")), "doc_id", classes, "sid")
    return rows.select("t").mapInArrow(
        run, "set_key binary, n bigint, wide binary, shingles binary")


def could_link(rule: Similarity, left: str = "l", right: str = "r") -> Column:
    """Sizes and signatures of two classes do not rule a link out."""
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    apart = " + ".join(f"bit_count({left}.{b} ^ {right}.{b})" for b in BIT_COLUMNS)
    return (100 * small >= rule.percent * large) & F.expr(
        f"{100 + rule.percent} * ({apart}) <= {100 - rule.percent} * ({left}.n + {right}.n)")


def promising(pairs: DataFrame, classes: DataFrame, rule: Similarity) -> DataFrame:
    """Distinct pairs (a, b) of classes with a < b that could link."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    light = classes.select("set_key", "n", *BIT_COLUMNS)
    return (
        ordered.join(light.alias("l"), F.col("a") == F.col("l.set_key"))
        .join(light.alias("r"), F.col("b") == F.col("r.set_key"))
        .filter(could_link(rule)).select("a", "b")
    )


def likely(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs that their wide signatures do not rule out, an eighth of a byte or two for a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, total = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [(100 + rule.percent) * bits_apart(left, right) <= (100 - rule.percent) * n
                    for left, right, n in zip(x, y, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", F.expr("na + nb").alias("total"))
    return both.mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs whose whole sets link. Only sets in a pair are shuffled, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (x, y))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key"))
    sets = likely_members(sets.select("set_key", "shingles"), "set_key", ends, "set_key")
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary")


def star_of_groups(postings: DataFrame, groups: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs of group leaders: each group with the centres of its shingles, filtered by size.

    A centre that serves one shingle of a larger group only is left out: this step need not find all.
    """
    hot = postings.filter("fan > 1").withColumn("band", F.expr(rule.band_sql("n")))
    tops = hot.groupBy("h", "band").agg(F.min("gid").alias("top"))
    pairs = postings.select("gid", "c", "n").unionByName(
        hot.select("h", "band", "c", "n").distinct().join(tops, ["h", "band"]).select(
            F.col("c").alias("gid"), F.col("top").alias("c"), "n"))
    pairs = pairs.filter("gid != c").groupBy("gid", "c").agg(F.count("*").alias("k"), F.min("n").alias("n")).filter(
        "k > 1 OR n < 20").select("gid", "c")
    one, two = groups.alias("l"), groups.alias("r")
    return pairs.join(one, F.col("gid") == F.col("l.g")).join(two, F.col("c") == F.col("r.g")).filter(
        100 * F.least("l.n", "r.n") >= rule.percent * F.greatest("l.n", "r.n")
    ).select(F.col("l.leader").alias("a"), F.col("r.leader").alias("b"))


def labelled(under: DataFrame, label: DataFrame, rule: Similarity) -> DataFrame:
    """The rows with each class's label as ``name``, its own key where it has none, and its size band.

    Few classes have a label; the rows of the others are not shuffled for one.
    """
    told = marked(under, "set_key", label, "set_key")
    some = told.filter("marked").drop("marked").join(label, "set_key", "left")
    others = told.filter("NOT marked").drop("marked").withColumn("label", F.lit(None).cast("binary"))
    return some.unionByName(others).select(
        *under.columns, F.coalesce("label", "set_key").alias("name"), F.expr(rule.band_sql("n")).alias("band"))


def apart(named: DataFrame, rule: Similarity) -> DataFrame:
    """The rows that a link between different labels could still need, and few others.

    A row is needed if its shingle has another label in a like size band. Labels only merge, so rows
    that leave are not needed later either.
    """
    known = named.withColumn("spot", F.xxhash64("h", "band"))
    mark = F.xxhash64("name")
    sides = named.groupBy("h", "band").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    like = Window.partitionBy("h").orderBy("band").rangeBetween(-1, 1)  # a row per band
    mixed = sides.select("h", "band", F.min("low").over(like).alias("low"), F.max("high").over(like).alias("high"))
    mixed = mixed.filter("low != high").select(F.xxhash64("h", "band").alias("spot"))
    return likely_members(known, "spot", mixed, "spot").drop("spot")


def crowded_rows(split: DataFrame, most: int = CROWD) -> DataFrame:
    """The rows under shingles that more than ``most`` rows share, and few others."""
    crowds = split.groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    return likely_members(split, "h", crowds, "h")


def centred(crowd: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each class under a crowded shingle with the shingle's centres, others each turn."""
    drawn = F.xxhash64("set_key", F.lit(turn))
    centre = crowd.groupBy("h", F.pmod(drawn, F.lit(CENTRES)).alias("part")).agg(
        F.min_by(F.struct("set_key", "name"), drawn).alias("c"))
    return crowd.join(centre.select("h", "c"), "h").filter("name != c.name").select(
        F.col("set_key").alias("a"), F.col("c.set_key").alias("b")).distinct()


def still_apart(split: DataFrame, classes: DataFrame, label: DataFrame, rule: Similarity,
                folder: str | None = None) -> DataFrame:
    """All pairs (a, b) of classes of different names that share enough shingles and could link.

    Units pair: the classes of one group that have one name, with identical prefix and size. A unit's
    smallest class stands for it, with its signature where it is alone and not too long to tell by it.
    Shingles beyond the prefixes that a pair's sizes need don't count. Unit pairs that share enough
    shingles expand to their classes, filtered by signature.

    Under a shingle of few units, all of them meet: both sides of that join are the same rows, shuffled
    once. Under a shingle of many units, those of the most frequent name do not look for partners among
    themselves: the join looks at no more than twice the pairs of different names. The others are
    salted, so that a task holds at most ``PAIRED_ROWS`` of them.
    """
    folder = folder or shared_folder(split.sparkSession)
    named = classes.join(label, "set_key", "left").withColumn("name", F.coalesce("label", "set_key"))
    by_unit = Window.partitionBy("gid", "name")
    member = named.select(
        "set_key", "n", *BIT_COLUMNS, F.min("set_key").over(by_unit).alias("unit"),
        F.count("*").over(by_unit).alias("members"))
    unit = member.filter("set_key = unit").select(
        "set_key", *(F.when(F.expr(f"members = 1 AND {rule.tells_apart_sql('n')}"), F.col(b)).alias(b)
                     for b in BIT_COLUMNS))
    rows = stored(split.select("h", "w", "n", "pos", "set_key", "name").join(unit, "set_key"), folder, "units")

    names = crowded_rows(rows.select("h", "name"), PAIRED_ROWS // 8).groupBy("h", "name").agg(F.count("*").alias("k"))
    many = names.groupBy("h").agg(
        F.sum("k").alias("rows"), F.max_by("name", F.struct("k", "name")).alias("top")
    ).filter(F.col("rows") > PAIRED_ROWS // 8)
    many = stored(many, folder, "many")
    hot = likely_members(rows, "h", many, "h").join(many, "h").withColumn(
        "fan", F.ceil(F.col("rows") / PAIRED_ROWS).cast("int"))
    one = hot.filter("name != top").withColumn(
        "salt", F.expr("CAST(pmod(xxhash64(set_key), fan) AS INT)")).alias("l")
    two = hot.withColumn("salt", F.explode(F.expr("sequence(0, fan - 1)"))).alias("r")
    other = (F.col("l.h") == F.col("r.h")) & (F.col("l.name") != F.col("r.name")) & F.expr(
        rule.in_prefix_sql()) & F.coalesce(could_link(rule), F.lit(True)) & (
        100 * F.least("l.n", "r.n") >= rule.percent * F.greatest("l.n", "r.n"))
    ordered = F.col("l.set_key") < F.col("r.set_key")
    cold = rows.join(many.select("h"), "h", "left_anti")
    # The smaller weight, which is either's: with the same columns, the sides share one shuffle.
    found = (F.least("l.set_key", "r.set_key").alias("a"), F.greatest("l.set_key", "r.set_key").alias("b"),
             F.least("l.w", "r.w").alias("w"), F.least("l.n", "r.n").alias("n"))
    met = cold.alias("l").join(cold.alias("r"), other & ordered).select(*found).unionByName(
        one.join(two, other & (F.col("l.salt") == F.col("r.salt")) & (
            ordered | (F.col("r.name") == F.col("r.top")))).select(*found))
    units = met.groupBy("a", "b").agg(F.sum("w").alias("k"), F.min("n").alias("n")).filter(
        f"k >= {rule.meets_sql('n')}").select("a", "b")
    return units.join(member.alias("l"), F.col("a") == F.col("l.unit")).join(
        member.alias("r"), F.col("b") == F.col("r.unit")).filter(could_link(rule)).select(
        F.least("l.set_key", "r.set_key").alias("a"), F.greatest("l.set_key", "r.set_key").alias("b"))


def _named(component: DataFrame) -> DataFrame:
    return component.select(F.col("a").alias("set_key"), F.col("b").alias("label"))


def linked(docs: DataFrame, rule: Similarity = Similarity(), text: str = "text") -> DataFrame:
    """``doc_id``, ``tie`` (hash of the text), ``n_shingles`` and ``component_id`` of every document."""
    return _linked(docs, rule, text).drop("label")


def _linked(docs: DataFrame, rule: Similarity, text: str) -> DataFrame:
    """The same with the component's ``label``, which also tells components of equal or no ids apart."""
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_folder(spark)
    profile = stored(profiles(docs, rule, text), folder, "profiles")
    classes = stored(set_classes(profile), folder, "classes")
    postings = stored(shared_postings(profile, rule), folder, "shared")
    postings = stored(enough(postings, rule), folder, "postings")
    release(spark)
    groups = classes.groupBy(F.col("gid").alias("g")).agg(
        F.min("set_key").alias("leader"), F.min("n").alias("n"), F.count("*").alias("members"))
    crowded = groups.filter("members > 1").select("g", "leader")

    # Classes that meet another one: by a shared prefix shingle, or in their group.
    meeting = postings.select(F.col("gid").alias("g")).unionByName(crowded.select("g")).distinct()
    met = stored(classes.join(meeting, F.col("gid") == F.col("g"), "left_semi"), folder, "met")
    own = met.join(crowded, F.col("gid") == F.col("g")).select(F.col("set_key").alias("a"), F.col("leader").alias("b"))
    pairs = star_of_groups(postings, groups, rule).unionByName(own)
    pairs = stored(promising(pairs, met, rule), folder, "pairs-1")

    def checked(pairs: DataFrame, turn: int) -> DataFrame:
        """The pairs that link, by the whole sets of the classes in them."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        needed = met.join(ends, "set_key", "left_semi").select("sid")
        sets = stored(sets_of(docs, needed, rule, text), folder, f"sets-{turn}")
        near = stored(likely(pairs, sets, rule), folder, f"likely-{turn}")
        found = stored(verified(near, sets, rule), folder, f"links-{turn}")
        release(spark)
        return found

    label = components(checked(pairs, 1), folder, "labels-1")

    # Every class under each of its shingles, and under its group if that holds others: those share
    # their whole prefix, which weighs as much as a link takes.
    # They get their names before that: there are fewer classes than shingles of them.
    named = stored(labelled(met.select("gid", "set_key", "n"), _named(label), rule), folder, "named")
    members = named.join(crowded, F.col("gid") == F.col("g")).select(
        F.col("gid").alias("h"), "set_key", "n", F.lit(0).alias("pos"), "name", "band")
    # One shuffle by group serves both.
    distinct = postings.select("h", "gid", "pos").repartition("gid").distinct()
    under = stored(
        distinct.join(named, "gid")
        .select("h", "set_key", "n", "pos", F.lit(1).alias("w"), "name", "band")
        .unionByName(members.withColumn("w", F.expr(rule.meets_sql("n")))),
        folder, "under")
    split = stored(apart(under, rule), folder, "apart")
    crowd, turn = stored(crowded_rows(split), folder, "crowd-1"), 1
    # Centres help as long as they find links; what stays apart then is mostly unlike.
    while not crowd.isEmpty() and turn <= MOST_STAR_ROUNDS:
        turn += 1
        pairs = stored(promising(centred(crowd, turn), met, rule), folder, f"pairs-{turn}")
        found = checked(pairs, turn)
        fresh = found.count()
        if fresh:  # the labels so far stand for the links that made them
            label = components(label.unionByName(found), folder, f"labels-{turn}")
        if fresh * LINKS_WORTH < pairs.count():
            break
        renamed = labelled(crowd.drop("name", "band"), _named(label), rule)
        crowd = stored(crowded_rows(apart(renamed, rule)), folder, f"crowd-{turn}")
    if turn > 1:
        renamed = labelled(split.drop("name", "band"), _named(label), rule)
        split = stored(apart(renamed, rule), folder, "last")
    if not split.isEmpty():
        pairs = stored(still_apart(split, met, _named(label), rule, folder), folder, "pairs-last")
        label = components(label.unionByName(checked(pairs, turn + 1)), folder, "labels-last")
    label = _named(label)

    named = classes.select("set_key", "sid").join(label, "set_key", "left").withColumn(
        "label", F.coalesce("label", "set_key"))
    smallest = named.groupBy("label").agg(F.min("sid").alias("component_id"))
    component = named.join(smallest, "label").select("set_key", "component_id", "label")
    return profile.select("doc_id", "tie", "n", "set_key").join(component, "set_key", "left").select(
        "doc_id", "tie", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "label")


def keep_one(docs: DataFrame, rule: Similarity = Similarity(), text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Where several texts of a component share that id, or all lack one, the smallest hash of the text
    decides. Rows that share id and text are one document and stay or leave together.
    """
    found = _linked(docs, rule, text).filter("n_shingles > 0")
    found = stored(found, shared_folder(docs.sparkSession), "components")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    firsts = found.filter(first).select("label", "doc_id", "tie").distinct()
    several = firsts.groupBy("label").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).filter("low != high")
    leaving = found.filter(~first).select("doc_id", "tie").distinct().unionByName(
        firsts.join(several, "label").filter("tie != low").select("doc_id", "tie")
    ).withColumnRenamed("doc_id", "d")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col("doc_id").alias("own"), F.xxhash64(whole(text)).alias("own_tie"))
    stay = rows.join(leaving, F.col("own").eqNullSafe(F.col("d")) & (F.col("own_tie") == F.col("tie")), "left_anti")
    return stay.select("row.*")
