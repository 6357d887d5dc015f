"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string arrays.  Everything here works on the raw UTF-8
bytes of a whole batch at once: word boundaries, 64-bit word hashes, hashes of
word windows and dictionary encoding, with no Python loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D; bytes of
multi-byte characters are never in that set, so byte and character semantics
agree.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)

#: Texts are hashed in slices of about this many bytes, which bounds memory.
SLICE_BYTES = 2 << 20


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.cast(pa.large_binary() if binary else pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if binary else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts [i, j) of about ``size`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the texts.

    ``cuts`` marks bytes within words at which another word begins.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    if cuts is not None:
        first |= cuts
        last[:-1] |= cuts[1:]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 permutation)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Runs of eight bytes that are hashed one after another; longer words are hashed by blocks of so many.
_CHAIN = 64


def _chained(values: np.ndarray, bounds: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each item's values, absorbed one after another into its start.

    A step mixes a value in on both sides of a permutation, so that no value makes up for
    a difference in those before it.
    """
    state, counts, left = start, np.diff(bounds), np.arange(len(start))
    for k in range(int(counts.max(initial=0))):
        if k:
            left = left[counts[left] > k]
        v = values[bounds[:-1][left] + k]
        state[left] = mix(state[left] + mix(v ^ U64(0x6C62272E07BB0142))) ^ (v * U64(0x9E3779B97F4A7C15))
    return state


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: their length, then their runs of eight bytes one after another."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    runs = (lengths + 7) >> 3
    bounds = np.concatenate([[0], np.cumsum(runs)])
    number = np.arange(bounds[-1]) - np.repeat(bounds[:-1], runs)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    value = eights[np.repeat(starts, runs) + 8 * number].view("<u8")[:, 0]
    last = bounds[1:][runs > 0] - 1
    value[last] &= _KEEP[((lengths[runs > 0] - 1) & 7) + 1]
    out = mix(lengths.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(1))
    while (long := np.flatnonzero(runs > _CHAIN)).size:
        # Blocks of long words become their values, until these are few.
        blocks = (runs + _CHAIN - 1) // _CHAIN
        blocks[runs <= _CHAIN] = runs[runs <= _CHAIN]
        fresh = np.concatenate([[0], np.cumsum(blocks)])
        made = np.empty(int(fresh[-1]), U64)
        short = np.flatnonzero(runs <= _CHAIN)
        made[ragged(fresh[short], runs[short])] = value[ragged(bounds[short], runs[short])]
        first = ragged(np.zeros(len(long), np.int64), blocks[long]) * _CHAIN
        size = np.minimum(np.repeat(runs[long], blocks[long]) - first, _CHAIN)
        begins = np.repeat(bounds[long], blocks[long]) + first
        inner = value[ragged(begins, size)]
        made[ragged(fresh[long], blocks[long])] = _chained(inner, np.concatenate([[0], np.cumsum(size)]), mix(size.astype(U64) + U64(2)))
        value, bounds, runs = made, fresh, blocks
    return mix(_chained(value, bounds, out))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + U64(0xD1342543DE82EF95)) + b)


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words (runs over text ends too), joined of runs of powers of two."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, at, power, size = None, 0, words, 1
    while True:
        if width & size:
            piece = power[at : at + n]
            out = piece if out is None else _joined(out, piece)
            at += size
        if 2 * size > width:
            return mix(out ^ U64(seed * 0xA0761D6478BD642F % (1 << 64)))
        power = _joined(power[:-size], power[size:])
        size *= 2


def hashed(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, word hashes, j - i + 1 word offsets) for runs of whole texts."""
    data, offsets = buffers(texts)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        part = LOWER[part] if lower else part
        starts, ends, at = spans(part, offsets[i : j + 1] - offsets[i])
        yield i, j, word_hashes(part, starts, ends), at


def encoded(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Index of each word into the distinct words, those words as binary, and the word offsets."""
    data, offsets = buffers(texts)
    return encoded_bytes(LOWER[data] if lower else data, offsets)


def encoded_bytes(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    starts, ends, at = spans(data, offsets, cuts)
    packed = data[~WHITE[data]] if len(data) else data
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of each run, one run after the other."""
    total = np.cumsum(lengths)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)
