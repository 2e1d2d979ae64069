"""Token ids in bit-packed files (operator 8).

Every id takes the minimum number of bits that the vocabulary needs. Files hold blocks of a fixed
number of ids, each packed on its own, then the documents' ids and lengths, the byte offsets of the
blocks, and a trailer of fixed size. Any block can be read and unpacked alone, with numpy.

Documents are range-partitioned and sorted by ``doc_id``; each task writes one file under a name of
its own in a shared folder, and only files of tasks that committed enter the manifest, so a lost or
repeated task leaves no wrong file in it. The number of ids before a document follows from a running
sum over the manifest, a row per file.

NULL and empty texts hold the end id only. Rows with equal ids keep a fixed order by text; a NULL
``doc_id`` comes first. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import no_collection, prepare, shared_folder, stored, whole

MAGIC = b"BITIDS01"
TRAILER = struct.Struct("<8sIIQQQ")  # magic, bits, ids in a block, ids, documents, offset of the index
BLOCK_IDS = 1 << 16
# What follows a space, and pre-tokens, that a worker process remembers; the tables start anew beyond that.
REMEMBERED = 1_000_000
REMEMBERED_PARTS = 600_000

_loaded: dict[str, object] = {}


# --- packing -----------------------------------------------------------------------------------

def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids side by side, ``bits`` bits each, in little-endian 64-bit words.

    64 ids fill exactly ``bits`` words, so the loop runs over 64 columns, not over ids.
    """
    rows = -(-len(ids) // 64)
    grid = np.zeros((rows, 64), dtype=np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    grid = np.empty((len(words), 64), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        grid[:, j] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            grid[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (grid.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Appends documents to one open file; blocks leave memory as they fill."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.offsets = [0]
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block_ids:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.array([], dtype="<u4")
        whole_blocks = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for start in range(0, whole_blocks, self.block_ids):
            data = pack(ids[start : min(start + self.block_ids, whole_blocks)], self.bits)
            self.stream.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [ids[whole_blocks:]], len(ids) - whole_blocks

    def close(self) -> None:
        self._flush(last=True)
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        names = np.array([0 if d is None else d for d in self.doc_ids], dtype="<i8")
        lengths = np.array(self.lengths, dtype="<i8")
        for part in (known, names, lengths, np.array(self.offsets, dtype="<i8")):
            self.stream.write(part.tobytes())
        self.stream.write(TRAILER.pack(MAGIC, self.bits, self.block_ids, self.ids, len(self.doc_ids), self.at))


@dataclass
class Index:
    """What a file says about its documents and blocks."""

    bits: int
    block_ids: int
    n_ids: int
    doc_ids: list[int | None]
    ends: np.ndarray
    offsets: np.ndarray


def read_index(file) -> Index:
    """The index of an open, seekable file."""
    size = file.size()
    file.seek(size - TRAILER.size)
    magic, bits, block_ids, n_ids, n_docs, at = TRAILER.unpack(file.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a file of packed ids")
    file.seek(at)
    data = file.read(size - TRAILER.size - at)
    known = np.frombuffer(data, np.uint8, n_docs)
    names = np.frombuffer(data, "<i8", n_docs, n_docs)
    lengths = np.frombuffer(data, "<i8", n_docs, 9 * n_docs)
    offsets = np.frombuffer(data, "<i8", -1, 17 * n_docs)
    doc_ids = [n if k else None for n, k in zip(names.tolist(), known.tolist(), strict=True)]
    return Index(bits, block_ids, n_ids, doc_ids, np.cumsum(lengths, dtype=np.int64), offsets)


def read_block(file, index: Index, block: int) -> np.ndarray:
    """The ids of one block."""
    file.seek(int(index.offsets[block]))
    data = file.read(int(index.offsets[block + 1] - index.offsets[block]))
    return unpack(data, index.bits, min(index.block_ids, index.n_ids - block * index.block_ids))


def read_document(file, index: Index, nth: int) -> np.ndarray:
    """Random access: the ids of the nth document, from the blocks that hold it alone."""
    end = int(index.ends[nth])
    start = int(index.ends[nth - 1]) if nth else 0
    if start == end:
        return np.array([], dtype="<u4")
    first = start // index.block_ids
    parts = [read_block(file, index, b) for b in range(first, (end - 1) // index.block_ids + 1)]
    return np.concatenate(parts)[start - first * index.block_ids : end - first * index.block_ids]


def documents(file, index: Index) -> Iterator[np.ndarray]:
    """The ids of all documents in order; a block is read once and leaves memory after use."""
    rest, following, start = np.array([], dtype="<u4"), 0, 0
    for end in index.ends.tolist():
        parts, have = [rest], len(rest)
        while have < end - start:
            parts.append(read_block(file, index, following))
            have += len(parts[-1])
            following += 1
        held = np.concatenate(parts) if len(parts) > 1 else rest
        yield held[: end - start]
        rest, start = held[end - start :], end


# --- encoding ----------------------------------------------------------------------------------

# A Latin word, marks after it, and the same once more on the next line. Letters, marks of ASCII and a
# single line feed between other characters always are pre-tokens of their own.
_MARKS = r"([!-/:-@\[-`{-~]*)"
_LATIN = r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+)"
_PARTS = re.compile(f"{_LATIN}{_MARKS}(?:(\n){_LATIN}{_MARKS})?")
# The character that stands for each byte in a byte-level vocabulary: its own if that is printable.
_OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_CHARACTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _OWN)}
_ZERO = chr(_CHARACTERS[0])


def byte_characters(text: str) -> str:
    """The bytes of a text as a byte-level vocabulary spells them."""
    return text.encode().decode("latin-1").translate(_CHARACTERS)


class _Numbers(dict):
    """Numbers strings in the order of their first use, from 0."""

    def __missing__(self, text: str) -> int:
        value = self[text] = len(self)
        return value


class _Known:
    """Ids of numbered strings, side by side."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids = np.array([], dtype="<u4")
        self.starts = np.array([], dtype=np.int64)
        self.lengths = np.array([], dtype=np.int64)

    def new(self) -> list[str]:
        """The strings that have a number but no ids yet."""
        return list(islice(reversed(self.numbers), len(self.numbers) - len(self.starts)))[::-1]

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the new strings."""
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these strings one after another, and how many each string has."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(total)], lengths


def _side_by_side(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), "<u4", int(lengths.sum())), lengths


class Encoder:
    """Byte-level encoding by the tokenizers library, one call per new pre-token or group of them.

    The library's pattern starts a new pre-token at every space that has a non-blank on either side,
    so a text cut there encodes piece by piece as it does whole. Pieces of Latin words and marks are
    cut further, into single pre-tokens, which the library's model merges directly. Texts that hold one of the vocabulary's special strings go to the library whole.
    Pieces are numbered once, and numpy gathers the ids of all texts of a batch by these numbers.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError("not a byte-level vocabulary without normalisation")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.spaced = _Known()
        self.parts = _Known()

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each text has."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return _side_by_side([e.ids for e in found])

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for single pre-tokens, and for other texts, which start with two spaces for one."""
        merge, ids = self.merge, [[]] * len(parts)
        mixed = [k for k, part in enumerate(parts) if part[:2] == "  "]
        found = self.tokenizer.encode_batch_fast([parts[k][1:] for k in mixed], add_special_tokens=False)
        for k, encoding in zip(mixed, found, strict=True):
            ids[k] = encoding.ids
        plain = [k for k, part in enumerate(parts) if part[:2] != "  "]
        if plain:
            # Spelled in one go: no pre-token here holds the character between them.
            spelled = byte_characters("\0".join([parts[k] for k in plain])).split(_ZERO)
            for k, part in zip(plain, spelled, strict=True):
                ids[k] = [token.id for token in merge(part)]
        return _side_by_side(ids)

    @staticmethod
    def _joined(text: str) -> list[str]:
        """The text cut at its safe spaces only."""
        first, *others = text.split(" ")
        out = [first]
        for piece in others:
            if (not out[-1] or out[-1][-1].isspace()) and (not piece or piece[0].isspace()):
                out[-1] += " " + piece
            else:
                out.append(" " + piece)
        return out

    def _learn(self) -> None:
        """Encodes new pieces, each after a space, from their pre-tokens; unsafe ones get no ids."""
        if len(self.parts.numbers) > REMEMBERED_PARTS:
            self.parts = _Known()
        number, made, counts = self.parts.numbers.__getitem__, [], []
        for piece in self.spaced.new():
            word = piece.rstrip(punctuation)
            if word.isascii() and word.isalpha():
                made.append(number(" " + word))
                if len(word) < len(piece):
                    made.append(number(piece[len(word) :]))
                    counts.append(2)
                else:
                    counts.append(1)
            elif not piece or piece[0].isspace():
                counts.append(0)
            elif form := _PARTS.fullmatch(piece):
                word, *others = form.groups()
                own = [" " + word, *filter(None, others)]
                made += map(number, own)
                counts.append(len(own))
            else:
                made.append(number("  " + piece))
                counts.append(1)
        new = self.parts.new()
        found = [self._merged(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        if found:
            self.parts.add(*map(np.concatenate, zip(*found, strict=True)))
        if counts:
            ids, lengths = self.parts.of(np.array(made, dtype=np.int64))
            part_ends, ends = np.r_[0, np.cumsum(lengths)], np.cumsum(counts)
            self.spaced.add(ids, np.diff(part_ends[np.r_[0, ends]]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        with no_collection():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.spaced.numbers) > REMEMBERED:
            self.spaced = _Known()
        plain = [not any(s in text for s in self.special) for text in texts]
        alone = [[text.split(" ", 1)[0] if cut else text] for text, cut in zip(texts, plain, strict=True)]
        # Arrow cuts the texts and finds each piece once; only these become Python strings.
        cut_texts = pa.array([text if cut else "" for text, cut in zip(texts, plain, strict=True)], pa.string())
        cuts = pc.split_pattern(cut_texts, " ")
        starts = cuts.offsets.to_numpy()
        after_space = np.ones(int(starts[-1]), dtype=bool)
        after_space[starts[:-1]] = False
        pieces = cuts.values.filter(pa.array(after_space)).dictionary_encode()
        n = len(pieces.dictionary)
        # No piece holds a space.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pieces.dictionary), " ")[0].as_py()
        distinct = joined.split(" ") if n else []
        numbers = np.fromiter(map(self.spaced.numbers.__getitem__, distinct), np.int64, n)[pieces.indices.to_numpy()]
        counts = np.diff(starts).astype(np.int64) - 1
        self._learn()
        ids, lengths = self.spaced.of(numbers)
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        # Before an empty piece or one that starts with a blank the space may not be safe.
        for i in np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(lengths == 0), side="right")).tolist():
            alone[i] = self._joined(texts[i])
            counts[i] = 0
        firsts = list({p for pieces in alone for p in pieces})
        found, sizes = self.library(firsts)
        raw = {p: found[end - size : end] for p, size, end in zip(firsts, sizes, np.cumsum(sizes), strict=True)}
        return [
            np.concatenate([*map(raw.__getitem__, own), ids[start:end] if count else ids[:0]])
            for own, count, (start, end) in zip(alone, counts, pairwise(ends.tolist()), strict=True)
        ]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


# --- files on Spark ----------------------------------------------------------------------------

MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"
ROWS = "doc_id bigint, start bigint, ids binary"


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes all documents' ids, ``end_id`` after each, and returns the stored manifest.

    ``folder`` is a URI that every executor can write, ``path`` the vocabulary file.
    """
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), encoder(path)
        files, place = _filesystem(f"{folder}/ids")
        writer = stream = None
        for batch in batches:
            if writer is None and batch.num_rows:
                files.create_dir(place, recursive=True)
                name = f"{place}/{shard:06d}-{uuid.uuid4().hex}.ids"
                stream = files.open_output_stream(name)
                writer = Writer(stream, coder.bits)
            end = np.array([end_id], dtype="<u4")
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": name, "n_docs": len(writer.doc_ids), "n_ids": writer.ids}],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select("doc_id", whole("text").alias("text")).repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), folder, "manifest")


def _filesystem(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (little-endian unsigned
    32-bit integers) of every document, read from the files of a manifest."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select(
        "shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with files.open_input_file(shard["path"]) as file:
                    index = read_index(file)
                    starts = np.r_[0, index.ends[:-1]] + shard["base"]
                    found = documents(file, index)
                    for lo, hi in pairwise([*range(0, len(index.doc_ids), 200), len(index.doc_ids)]):
                        ids = [next(found).tobytes() for _ in range(lo, hi)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.doc_ids[lo:hi], pa.int64()), pa.array(starts[lo:hi], pa.int64()),
                             pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    # A number of its own: left to itself, Spark would read all these few rows in one task.
    spread = shards.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, ROWS)


def packed_documents(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """The documents' ids after a round trip through the files."""
    folder = folder or shared_folder(docs.sparkSession)
    return read_ids(write_ids(docs, path, folder, end_id), folder)


def checksums(ids: DataFrame) -> DataFrame:
    """Start, length and CRC-32 of each document's ids."""
    return ids.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
