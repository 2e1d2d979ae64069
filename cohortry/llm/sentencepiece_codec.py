"""SentencePiece encoding and decoding (operator 1).

Texts are encoded by the score-ordered agendas of ``merges`` and checked in the same Arrow batch:
every chunk that a worker meets for the first time is also encoded by the sentencepiece library, and
a difference stops the job. Known chunks come from a bounded table per worker process. Ids are
decoded by the library's ``decode(ids)`` over the whole document.

NULL and empty texts have no ids and decode to empty text. Order, ties and repeated rows do not
matter: each row is encoded by itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import lean, no_collection, prepare, whole
from cohortry.llm.merges import Vocabulary, vocabulary

# A worker process remembers the chunks of its latest texts, and those of the texts before; the former take
# the place of the latter when there are more than this.
REMEMBERED = 350_000
# Texts of a batch that are encoded and decoded at a time, and new chunks whose agendas run side by side.
TEXTS = 100
CHUNKS = 8_192

_known: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_library: dict[str, object] = {}


class Mismatch(RuntimeError):
    """The agendas and the library disagree on a chunk."""


def library(path: str):
    """The library's processor of a model file, loaded once per process."""
    if path not in _library:
        import sentencepiece

        _library[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _library[path]


def _checked(vocab: Vocabulary, processor, chunks: list[str]) -> list[tuple[int, ...]]:
    """The ids of the chunks by agenda; the library has to agree on each."""
    ours = vocab.encode_chunks(chunks)
    # The library puts a space before a text; a chunk that has none of its own follows a line feed.
    spaced = [c.startswith(" ") for c in chunks]
    theirs = processor.encode([c[1:] if s else "\n" + c for c, s in zip(chunks, spaced, strict=True)], num_threads=1)
    lead = len(processor.encode("\n"))
    for chunk, space, mine, other in zip(chunks, spaced, ours, theirs, strict=True):
        if chunk != " " and mine != tuple(other if space else other[lead:]):
            raise Mismatch(f"{chunk[:80]!r}: {mine[:20]} and {other[:20]}")
    return ours


def encode_texts(texts: list[str], path: str, remembered: int = REMEMBERED) -> list[np.ndarray]:
    """Token ids of each text, as the library gives them without begin and end ids."""
    with no_collection():
        return _encode_texts(texts, path, remembered)


def _encode_texts(texts: list[str], path: str, remembered: int) -> list[np.ndarray]:
    vocab, processor = vocabulary(path), library(path)
    found = []
    for at in range(0, len(texts), TEXTS):
        latest, before = _known.get(path, ({}, {}))
        if len(latest) > remembered:
            latest, before = {}, latest
        _known[path] = latest, before
        cut = [vocab.chunks(t) for t in texts[at : at + TEXTS]]
        new = set().union(*cut) - latest.keys()
        missing = [chunk for chunk in new if chunk not in before]
        latest.update((chunk, before[chunk]) for chunk in new if chunk in before)
        for first in range(0, len(missing), CHUNKS):
            some = missing[first : first + CHUNKS]
            for ids, chunk in zip(_checked(vocab, processor, some), some, strict=True):
                latest[chunk] = np.array(ids, dtype="<i4").tobytes()
        found += [np.frombuffer(b"".join(map(latest.__getitem__, chunks)), dtype="<i4") for chunks in cut]
    return found


def codec(path: str, remembered: int = REMEMBERED):
    """A column function text -> struct(ids, decoded)."""

    @F.arrow_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = library(path)
        for texts in lean(batches):
            ids, decoded = [], [pa.array([], pa.string())]
            for at in range(0, len(texts), TEXTS):
                found = encode_texts(texts[at : at + TEXTS].to_pylist(), path, remembered)
                decoded.append(pa.array(processor.decode([i.tolist() for i in found], num_threads=1), pa.string()))
                ids += found
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                 pa.concat_arrays(decoded)], names=["ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, text: str | Column = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every document.

    ``path`` names a merge-type model file that every executor can open. ``remembered`` bounds a worker's
    memory, not the result.
    """
    prepare(docs.sparkSession)
    both = codec(path, remembered)(whole(text))
    return docs.select("doc_id", both.alias("both")).select("doc_id", "both.ids", "both.decoded")


def digests(coded: DataFrame) -> DataFrame:
    """Number of ids and SHA-256 of the ids as decimal text and of the decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
