"""Quality rules with compression bands (operator 4).

Word, symbol and repetition counts make the base rules. The method adds zstandard ratios (compressed
bytes per byte) of the whole document and of fixed chunks: text that repeats itself compresses below
a lower limit, noise stays above an upper one. Both limits depend on the length, since short text
compresses less. A document is rejected when its own ratio leaves the band of its length, or when
more than a share of its chunks leave theirs.

NULL and empty texts have no words and fail the base rules. Every row is judged by itself; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import lean, prepare, whole

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes per byte.

    Upper limits lie 5 to 15 % above the highest ratio of clean text of that length, lower ones at
    about two thirds of the lowest; both were measured on every document that passes the base rules.
    ``by_bytes``: (from that many bytes on, lower limit, upper limit), ascending. ``chunk`` bytes make
    a chunk; a last piece shorter than half of that is left out, as is a document of one chunk only.
    """

    by_bytes: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (128, 0.30, 0.95),
        (256, 0.34, 0.80),
        (512, 0.30, 0.74),
        (1024, 0.27, 0.65),
        (2048, 0.25, 0.59),
        (4096, 0.24, 0.58),
        (8192, 0.23, 0.52),
        (16384, 0.22, 0.50),
    )
    chunk: int = 2048
    chunk_share: float = 0.25
    level: int = 3

    def inside(self, size: int, packed: int) -> bool:
        low, high = next((lo, hi) for start, lo, hi in reversed(self.by_bytes) if size >= start)
        return low * size <= packed <= high * size


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    kinds = len(number)
    pairs = ids[:-2] * kinds + ids[1:-1]
    if kinds > 2_000_000:  # the product of three numbers would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * kinds + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """The values of ``FIELDS`` for a text."""
    # bytes.split() cuts at exactly the six blanks.
    words = text.encode().split()
    blanks = sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def ratios(data: bytes, packer, bands: Bands) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks, chunks outside their band, and the verdict."""
    size = len(data)
    packed = len(packer.compress(data)) if size else 0
    verdict = bands.inside(size, packed)
    chunks = outside = 0
    if size > bands.chunk:
        for start in range(0, size, bands.chunk):
            piece = data[start : start + bands.chunk]
            if 2 * len(piece) >= bands.chunk:
                chunks += 1
                outside += not bands.inside(len(piece), len(packer.compress(piece)))
    return packed / size if size else 0.0, chunks, outside, verdict and outside <= bands.chunk_share * chunks


def measures(bands: Bands = Bands()):
    """A column function text -> struct of counts, ratios and the bands' verdict."""
    counts = ", ".join(f"{name} bigint" for name in FIELDS)

    @F.arrow_udf(f"{counts}, ratio double, n_chunks bigint, n_chunks_outside bigint, in_bands boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level)
        for texts in lean(batches):
            rows = []
            for scalar in texts:
                text = scalar.as_py()
                rows.append((*text_counts(text), *ratios(text.encode(), packer, bands)))
            columns = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) + 4)
            kinds = [pa.int64()] * len(FIELDS) + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[*FIELDS, "ratio", "n_chunks", "n_chunks_outside", "in_bands"])

    return run


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Under 50 words, or more than half of them in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge(docs: DataFrame, bands: Bands = Bands(), text: str | Column = "text") -> DataFrame:
    """Every document's counts, ratios, ``base_failed`` and ``kept``."""
    prepare(docs.sparkSession)
    found = docs.select("doc_id", measures(bands)(whole(text)).alias("m")).select("doc_id", "m.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("in_bands"))


def keep_good(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns and nothing else."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       measures(bands)(whole(text)).alias("m"))
    failed = base_failed(F.col("m.n_words"), F.col("m.n_repeat_words"))
    return rows.filter(~failed & F.col("m.in_bands")).select("row.*")
