"""Merge-type SentencePiece vocabularies: score-ordered agendas over adjacent symbol pairs.

Encoding keeps, for every word, an agenda of the adjacent symbol pairs whose concatenation is a
piece. The pair with the highest score is merged first, the leftmost among equals; its neighbours
form new pairs; the word is done when the agenda is empty. ``Vocabulary.encode_chunks`` runs the
agendas of many short chunks side by side, one merge per chunk and round, as numpy arrays; long
chunks use one heap each.

Texts are cut into chunks first, at places no piece crosses: before a space that follows another
character and around line feeds. ``Vocabulary`` proves both from the piece list when it loads.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np

SPACE = "▁"
# Chunks beyond this many characters use a heap of their own.
SIDE_BY_SIDE = 48
NO_PAIR = np.int64(2**62)
# Kinds of pieces in a model file.
NORMAL, USER, UNUSED, BYTE = 1, 4, 5, 6


class UnsupportedModel(ValueError):
    """The model is not a merge-type vocabulary that this module encodes exactly."""


class Vocabulary:
    """Pieces, scores and pair table of a merge-type model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self._demand(model)
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        # Byte pieces read <0x00> to <0xFF>.
        named = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes = [named[f"<0x{b:02X}>"] for b in range(256)]

        # A symbol is a piece or a single character of one; symbols of pieces come first.
        self.symbols = list(pieces)
        self.token = list(pieces.values())
        number = {s: i for i, s in enumerate(self.symbols)}
        for char in sorted(set(chain.from_iterable(pieces)) - set(number)):
            number[char] = len(self.symbols)
            self.symbols.append(char)
            self.token.append(-1)
        self.number = number
        scores = np.array([model.pieces[t].score if t >= 0 else 0.0 for t in self.token])
        # Equal scores share a rank, so that position alone decides between them.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.pairs = {
            (number[s[:cut]], number[s[cut:]]): number[s]
            for s in pieces
            for cut in range(1, len(s))
            if s[:cut] in number and s[cut:] in number
        }
        keys = np.array([left << 24 | right for left, right in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._made = np.array(list(self.pairs.values()), dtype=np.int64)[order]
        self._of_char = np.full(0x110000, len(self.symbols), dtype=np.int64)
        for symbol, i in number.items():
            if len(symbol) == 1:
                self._of_char[ord(symbol)] = i

        if any(SPACE in s.lstrip(SPACE) for s in pieces):
            raise UnsupportedModel("a piece holds a space after another character")
        lines = not any("\n" in s for s in pieces if len(s) > 1)
        self._cut = re.compile(r" *[^ \n]+| +|\n" if lines else r" *[^ ]+| +").findall

    @staticmethod
    def _demand(model) -> None:
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        if model.trainer_spec.model_type != 2 or USER in kinds or UNUSED in kinds:
            raise UnsupportedModel("not a plain merge-type vocabulary")
        if not (plain and norm.add_dummy_prefix and norm.escape_whitespaces):
            raise UnsupportedModel("texts are normalised before encoding")
        if model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise UnsupportedModel("spaces end a piece, or unknown characters have no bytes")

    def chunks(self, text: str) -> list[str]:
        """The text behind its leading space, cut where no piece crosses; nothing for no text."""
        text = text.replace(SPACE, " ")
        return self._cut(f" {text}") if text else []

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        """Token ids of final symbols; a character without a piece becomes its bytes."""
        found: list[int] = []
        for symbol in symbols:
            i = self.number.get(symbol, -1)
            if i >= 0 and self.token[i] >= 0:
                found.append(self.token[i])
            else:
                found.extend(self.bytes[b] for b in symbol.encode())
        return tuple(found)

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """One chunk by a heap of its own; n log n steps for any length."""
        symbols: list[str] = list(chunk.replace(" ", SPACE))
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        number = [self.number.get(s, -1) for s in symbols]
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                made = self.pairs.get((number[left], number[right]))
                if made is not None:
                    heapq.heappush(agenda, (int(self.rank[made]), left, right, number[left], number[right]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, was_left, was_right = heapq.heappop(agenda)
            if number[left] != was_left or number[right] != was_right or after[left] != right:
                continue  # one of the two has been merged meanwhile
            number[left] = self.pairs[was_left, was_right]
            symbols[left], symbols[right] = self.symbols[number[left]], ""
            number[right] = -2
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        return self._ids([s for s in symbols if s])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation above 24 bits of its symbol; NO_PAIR for no piece."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        made = self._made[at]
        return np.where(self._keys[at] == key, self.rank[made] << 24 | made, NO_PAIR)

    def _side_by_side(self, chunks: list[str]) -> list[tuple[int, ...]]:
        text = "".join(chunks).replace(" ", SPACE)
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        word = np.repeat(np.arange(len(chunks)), sizes)
        symbol = self._of_char[code]
        plain = np.ones(len(chunks), dtype=bool)
        plain[word[symbol == len(self.symbols)]] = False  # characters of no piece: a heap each
        done_word, done_symbol = [], []
        live = plain[word]
        symbol, word = symbol[live], word[live]
        pair = self._agenda(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            # The best pair of a word: lowest rank, then leftmost.
            best = np.minimum.reduceat(pair >> 24, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            open_words = best < NO_PAIR >> 24
            if not open_words.all():
                live = np.repeat(open_words, sizes)
                done_word.append(word[~live])
                done_symbol.append(symbol[~live])
                symbol, word, pair = symbol[live], word[live], pair[live]
                if not len(symbol):
                    break
                best, sizes = best[open_words], sizes[open_words]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hits = np.flatnonzero(pair >> 24 == np.repeat(best, sizes))
            first = np.r_[True, word[hits][1:] != word[hits][:-1]]
            at = hits[first]
            symbol[at] = pair[at] & 0xFFFFFF
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, word, pair = symbol[keep], word[keep], pair[keep]
            at -= np.arange(len(at))
            changed = np.r_[at[at > 0] - 1, at]
            pair[changed] = self._agenda_at(symbol, word, changed)
        out: list[tuple[int, ...]] = [()] * len(chunks)
        if done_word:
            words, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
            order = np.argsort(words, kind="stable")
            words, symbols = words[order], symbols[order]
            tokens = np.array(self.token, dtype=np.int64)[symbols]
            odd = np.zeros(len(chunks), dtype=bool)
            odd[words[tokens < 0]] = True
            starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            ends = np.r_[starts[1:], len(words)].tolist()
            listed = tokens.tolist()
            for w, lo, hi in zip(words[starts].tolist(), starts.tolist(), ends, strict=True):
                out[w] = tuple(listed[lo:hi])
            plain &= ~odd
        for w in np.flatnonzero(~plain).tolist():
            out[w] = self.encode_chunk(chunks[w])
        return out

    def _agenda_at(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        following = np.minimum(at + 1, len(symbol) - 1)
        inside = (at + 1 < len(symbol)) & (word[following] == word[at])
        return np.where(inside, self._pair(symbol[at], symbol[following]), NO_PAIR)

    def _agenda(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._agenda_at(symbol, word, np.arange(len(symbol)))

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Token ids of each chunk."""
        short = [i for i, c in enumerate(chunks) if len(c) <= SIDE_BY_SIDE]
        out: list[tuple[int, ...]] = [()] * len(chunks)
        for i, ids in zip(short, self._side_by_side([chunks[i] for i in short]), strict=True):
            out[i] = ids
        for i, chunk in enumerate(chunks):
            if len(chunk) > SIDE_BY_SIDE:
                out[i] = self.encode_chunk(chunk)
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        return list(chain.from_iterable(self.encode_chunks(self.chunks(text))))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]
