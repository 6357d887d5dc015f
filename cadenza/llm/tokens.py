"""Token ids of whole texts by the tokenizers library, word by word.

The vocabulary's normaliser and pre-tokeniser never join characters across
ASCII white space, so the ids of a text are those of its words in a row.  Each
distinct word is encoded once in a worker and remembered, up to a bound.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from . import text as T

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers, and their bytes, before it starts anew.
MEMORY_WORDS, MEMORY_BYTES = 1_000_000, 16 << 20
#: Bytes of text encoded at a time.
SLICE_BYTES = 16 << 20

ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = True
#: ASCII characters next to which a run of letters always ends (an apostrophe may begin a contraction).
STOP = np.zeros(256, bool)
STOP[33:127] = ~ALPHA[33:127]
STOP[39] = False

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts without special tokens being added, as ``Tokenizer.encode`` does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of the words known, sorted
        self.place = np.zeros(0, np.int64)  # where each has its bounds
        self.flat = np.zeros(1 << 16, np.uint16)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.size = 0
        self.raw = np.zeros(1 << 16, np.uint8)  # the bytes of the words known, as hashes alone don't tell
        self.raw_bounds = np.zeros(1 << 14, np.int64)

    def unit(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() else piece.encode().decode("latin1").translate(self.alphabet)
        return [token.id for token in self.model.tokenize(shown)]

    def word(self, raw: bytes) -> list[int]:
        word = raw.decode("utf-8", "replace")
        if word.isascii() and word.isalpha():
            return self.unit(word.lower())
        if "<|" in word or not (max(word) < "ɐ" and word.isprintable() and unicodedata.is_normalized("NFC", word)):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for piece in self.pieces(word.lower()) for i in self.unit(piece)]

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as 16-bit integers, and the n + 1 offsets between texts."""
        data, offsets = T.buffers(texts)
        ids, at = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
        for i, j in T.slices(offsets, SLICE_BYTES):
            got, bounds = self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(got)
            at.append(bounds[1:] + at[-1][-1])
        return np.concatenate(ids), np.concatenate(at)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = None
        if b"<|" not in data.tobytes():  # else a special token's string may stand in a word
            data = T.LOWER[data]
            alpha, stop = ALPHA[data], STOP[data]
            pair = (data[:-1] == 0xC3) & (data[1:] >= 0xA0) & (data[1:] != 0xB7)  # small letters of Latin-1
            alpha[:-1] |= pair
            alpha[1:] |= pair
            cuts = np.zeros(len(data), bool)
            cuts[1:] = alpha[:-1] & stop[1:] | stop[:-1] & alpha[1:]
        index, distinct, at = T.encoded_bytes(data, offsets, cuts)
        raw, bounds = T.buffers(distinct)
        if len(self.hashes) + len(distinct) > MEMORY_WORDS or self.raw_bounds[len(self.hashes)] + len(raw) > MEMORY_BYTES:
            self.forget()
        hashes = T.word_hashes(raw, bounds[:-1], bounds[1:])
        at_known = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        hit = self.hashes[at_known] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        if not hit.all():
            self._learn(hashes[~hit], distinct.filter(pa.array(~hit)))
        place = self.place[np.searchsorted(self.hashes, hashes)]
        start, length = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        other = self._differ(place, raw, bounds)
        flat = self.flat
        if len(other):  # words whose hash another word holds
            fresh = [self.word(w) for w in distinct.take(pa.array(other)).to_pylist()]
            length[other] = [len(ids) for ids in fresh]
            start[other] = len(flat) + np.cumsum(length[other]) - length[other]
            flat = np.concatenate([flat, np.array([i for ids in fresh for i in ids], np.uint16)])
        lengths = length[index]
        ids = flat[T.ragged(start[index], lengths)]
        total = np.zeros(len(index) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids, total[at]

    def _differ(self, place: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which of the words are not the ones remembered at these places."""
        size, begin = np.diff(bounds), self.raw_bounds[place]
        wrong = self.raw_bounds[place + 1] - begin != size
        same = np.where(wrong, 0, size)
        unlike = np.flatnonzero(raw[T.ragged(bounds[:-1], same)] != self.raw[T.ragged(begin, same)])
        wrong[np.searchsorted(np.cumsum(same), unlike, "right")] = True
        return np.flatnonzero(wrong)

    def _learn(self, hashes: np.ndarray, words: pa.Array) -> None:
        hashes, own = np.unique(hashes, return_index=True)
        words = words.take(pa.array(own))
        fresh = [self.word(w) for w in words.to_pylist()]
        first, n = len(self.hashes), len(self.hashes) + len(fresh)
        ends = self.size + np.cumsum([len(ids) for ids in fresh])
        raw, at = T.buffers(words)
        self.bounds, self.raw_bounds = _room(self.bounds, n + 1), _room(self.raw_bounds, n + 1)
        raw_size = int(self.raw_bounds[first])
        self.flat, self.raw = _room(self.flat, int(ends[-1])), _room(self.raw, raw_size + len(raw))
        self.bounds[first], self.bounds[first + 1 : n + 1] = self.size, ends
        self.flat[self.size : ends[-1]] = [i for ids in fresh for i in ids]
        self.raw_bounds[first + 1 : n + 1] = raw_size + at[1:]
        self.raw[raw_size : raw_size + len(raw)] = raw
        self.size = int(ends[-1])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.place = every[order], np.concatenate([self.place, np.arange(first, n)])[order]


def _room(x: np.ndarray, size: int) -> np.ndarray:
    return x if len(x) >= size else np.concatenate([x, np.zeros(2 * size - len(x), x.dtype)])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
