"""Checksums of the formats, over bytes in Python; ``column`` lifts one to a DataFrame column.

Unreflected CRC-32 is had from zlib's reflected one on bytes with their bits
reversed; the narrower ones go by table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _table(polynomial: int, width: int) -> list[int]:
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    """Polynomial 0x07, start 0."""
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes, start: int = 0) -> int:
    """Polynomial 0x8005, most significant bit first; MPEG audio starts at 0xFFFF."""
    c = start
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


def crc32_ogg(data: bytes) -> int:
    """Polynomial 0x04C11DB7, most significant bit first, start and end 0."""
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


#: Bytes of a piece of a row; the pieces of all rows of a slice go side by side.
PIECE = 256
#: Bytes of the rows that are gone through together, which bounds memory; a longer row goes alone.
SLICE = 4 << 20


def _steps16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-16 of many runs of bytes, from a state each: one vector step for each place in a run."""
    order = np.argsort(-lengths, kind="stable")
    c, at, shorter, table = states[order].astype(np.uint16), starts[order], -lengths[order], np.array(_CRC16, np.uint16)
    for k in range(-int(shorter[0]) if len(shorter) else 0):
        live = int(np.searchsorted(shorter, -k, "left"))
        c[:live] = c[:live] << 8 ^ table[c[:live] >> 8 ^ data[at[:live] + k]]
    out = np.empty(len(c), np.int64)
    out[order] = c
    return out


@cache
def _over_piece() -> tuple[np.ndarray, np.ndarray]:
    """What a piece of zeros makes of a state, by its high and its low byte: steps are linear."""
    n, zeros = np.zeros(256, np.int64), np.zeros(PIECE, np.uint8)
    return tuple(_steps16(zeros, n, n + PIECE, np.arange(256) << shift) for shift in (8, 0))


def sliced_crc16(data: np.ndarray, offsets: np.ndarray, start: int = 0) -> np.ndarray:
    """crc16 of each row of bytes, by pieces that end where the row does; only a row's first piece may be short."""
    lengths = np.diff(offsets)
    pieces = np.maximum(1, -(-lengths // PIECE))
    first = np.cumsum(pieces) - pieces
    ends = np.repeat(offsets[1:], pieces) - (np.repeat(first + pieces, pieces) - 1 - np.arange(int(pieces.sum()))) * PIECE
    begins = ends - PIECE
    begins[first] = offsets[:-1]
    states = np.zeros(len(ends), np.int64)
    states[first] = start
    own = _steps16(data, begins, ends - begins, states)
    c, left, (high, low) = own[first], np.arange(len(lengths)), _over_piece()
    for k in range(1, int(pieces.max(initial=0))):
        left = left[pieces[left] > k]
        c[left] = high[c[left] >> 8] ^ low[c[left] & 255] ^ own[first[left] + k]
    return c


def lockstep_crc16(rows: list[bytes], start: int = 0) -> np.ndarray:
    """crc16 of many rows at a time."""
    return sliced_crc16(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]), start)


def column(of: Callable[[bytes], int], data: Column) -> Column:
    """A checksum of a binary or string column, as a long (64-bit values wrap to signed); null stays null."""

    def run(rows: pa.Array) -> pa.Array:
        found = (of(x.as_py()) if x.is_valid else None for x in rows)
        return pa.array([v - (1 << 64) if v is not None and v >= 1 << 63 else v for v in found], pa.int64())

    return F.arrow_udf(run, "long")(data.cast("binary"))


def crc16_array(rows: pa.Array, start: int = 0) -> pa.Array:
    """crc16 of each row of a binary array, slice by slice; null stays null."""
    rows = rows.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
    out, i = np.empty(len(rows), np.int64), 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        out[i:j] = sliced_crc16(data, offsets[i : j + 1], start)
        i = j
    return pa.array(out, mask=rows.is_null().to_numpy(zero_copy_only=False))


def crc16_column(data: Column, start: int = 0) -> Column:
    """crc16 of a binary or string column, as a long; null stays null."""
    return F.arrow_udf(lambda rows: crc16_array(rows, start), "long")(data.cast("binary"))
