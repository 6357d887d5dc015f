"""Bit allocation of the low-delay codec: whole batches of frames at once, in eighths of bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosts import EDGES, LOG_WIDTHS

#: Cost of a uniform choice among i, for i from 0; fixed values of the codec.
CHOICE = (0, 8, 13, 16, 19, 21, 23, 24, 26, 27, 28, 29, 30, 31, 32, 32, 33, 34, 34, 35, 36, 36, 37, 37)
FINE_MOST, FINE_OFFSET = 8, 21


def ruled_rows(rows: int = 11) -> np.ndarray:
    """Allocation rows by a rule, where the caller has none: bits fall along the bands, more slowly in each further row."""
    r, j = np.arange(rows)[:, None], np.arange(len(LOG_WIDTHS))
    return np.where(r == 0, 0, np.clip(80 + 12 * r - (9 * j * (rows - r) // rows), 0, 200))


def ruled_caps() -> np.ndarray:
    """Caps of bands by a rule, in the codec's packed unit."""
    return 220 - 5 * np.arange(len(LOG_WIDTHS))


@dataclass(frozen=True)
class Mode:
    """Rows (ascending in each band) and caps of 21 bands, channels, and the logarithm of the frame's size in shortest frames."""

    rows: np.ndarray
    caps: np.ndarray
    channels: int
    scale: int

    @property
    def lines(self) -> np.ndarray:
        return np.diff(EDGES)

    @property
    def cap(self) -> np.ndarray:
        return (np.asarray(self.caps) + 64) * self.channels * (self.lines << self.scale) >> 2

    @property
    def least(self) -> np.ndarray:
        return np.maximum(self.channels << 3, (3 * self.lines << self.scale << 3) >> 4)


def largest(fits: Callable[[np.ndarray], np.ndarray], top: int, rows: int) -> np.ndarray:
    """For each row the largest step up to ``top`` that fits; 0 if none does.  What fits must be so for all lesser steps."""
    found = np.zeros(rows, np.int64)
    for bit in reversed(range(top.bit_length())):
        tried = found + (1 << bit)
        found = np.where((tried <= top) & fits(np.minimum(tried, top)), tried, found)
    return found


def _kept(bits: np.ndarray, mode: Mode) -> np.ndarray:
    """Bands up to the last that reaches its threshold, capped; those above it keep a floor or nothing."""
    reached = np.logical_or.accumulate((bits >= mode.least)[:, ::-1], axis=1)[:, ::-1]
    base = mode.channels << 3
    return np.minimum(np.where(reached, bits, np.where(bits >= base, base, 0)), mode.cap)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sign(a) * (abs(a) // b)


def curve(total: np.ndarray, trim: np.ndarray, offsets: np.ndarray, mode: Mode) -> np.ndarray:
    """Bits of bands on the curve that just fits, between two rows in 64ths."""
    n, c = len(mode.lines), mode.channels
    tilt = (c * mode.lines * (trim[:, None] - 5 - mode.scale) * (n - 1 - np.arange(n)) << (mode.scale + 3)) >> 6
    tilt = tilt - np.where(mode.lines << mode.scale == 1, c << 3, 0)
    table = (c * mode.lines * np.asarray(mode.rows) << mode.scale) >> 2

    def row(k: np.ndarray) -> np.ndarray:
        return np.where(table[k] > 0, np.maximum(table[k] + tilt, 0), table[k])

    top = len(table) - 1
    fits = lambda bits: _kept(bits, mode).sum(1) <= total
    low = largest(lambda k: fits(row(k) + offsets), top, len(total))
    first = row(low) + np.where(low[:, None] > 0, offsets, 0)
    last = low == top
    second = np.where(last[:, None], np.where(mode.cap > 0, np.maximum(mode.cap + tilt, 0), 0), row(np.minimum(low + 1, top))) + offsets
    rise = np.maximum(second - first, 0)
    at = lambda k: first + (k[:, None] * rise >> 6)
    return _kept(at(largest(lambda k: fits(at(k)), 63, len(total))), mode)


def allocate(total: np.ndarray, trim: np.ndarray, offsets: np.ndarray, intensity: np.ndarray, dual: np.ndarray, before: np.ndarray, mode: Mode) -> dict[str, np.ndarray]:
    """Pulses and fine bits of bands for each row; every eighth is a band's, the side's or the balance.

    Bands are dropped from the top while they can't hold a flag and their floor; the loops go
    over bands, with all rows of a batch at once.  ``before``: bands coded in the last frame;
    the signal is taken to reach the top band.
    """
    count, n, c = len(total), len(mode.lines), mode.channels
    stereo = c > 1
    total = np.maximum(total, 0).astype(np.int64)
    flag = np.where(total >= 8, 8, 0)
    total = total - flag
    shared, both = np.zeros(count, np.int64), np.zeros(count, np.int64)
    if stereo:
        shared = np.where(CHOICE[n] <= total, CHOICE[n], 0)
        total = total - shared
        both = np.where((shared > 0) & (total >= 8), 8, 0)
        total = total - both
    pulses = curve(total, trim, offsets, mode)
    spent = pulses.sum(1)
    edges = np.asarray(EDGES)
    held = np.where((offsets > 0).any(1), n - 1 - (offsets > 0)[:, ::-1].argmax(1), 0)
    coded, side, going = np.full(count, n), np.zeros(count, np.int64), np.ones(count, bool)
    base = c << 3
    for j in reversed(range(n)):
        end = going & (j <= held)
        total = total + np.where(end, flag, 0)
        going = going & ~end
        left = total - spent
        each = _quotient(left, edges[j + 1])
        width = mode.lines[j]
        bits = pulses[:, j] + each * width + np.maximum(left - each * edges[j + 1] - edges[j], 0)
        asked = going & (bits >= max(mode.least[j], base + 8))
        deep = np.where(j < before, 7, 9) if j + 1 > 17 else np.zeros(count, np.int64)
        stays = asked & ((j + 1 <= 2) | (bits > (deep * width << mode.scale << 3) >> 4))
        side = side + np.where(asked, 8, 0)
        going = going & ~stays
        spent = spent + np.where(going & asked, 8, 0)
        bits = bits - np.where(asked, 8, 0)
        lesser = np.where(shared > 0, CHOICE[j], 0)
        rest = np.where(bits >= base, base, 0)
        spent = np.where(going, spent - pulses[:, j] - shared + lesser + rest, spent)
        shared = np.where(going, lesser, shared)
        pulses[:, j] = np.where(going, rest, pulses[:, j])
        coded = coded - going
    intensity = np.where(shared > 0, np.minimum(intensity, coded), 0)
    total = total + np.where(intensity <= 0, both, 0)
    both = np.where(intensity <= 0, 0, both)
    dual = np.where(both > 0, dual, 0)

    left = total - spent
    each = _quotient(left, edges[coded])
    left = left - each * edges[coded]
    inside = np.arange(n) < coded[:, None]
    pulses = pulses + np.where(inside, each[:, None] * mode.lines + np.minimum(np.maximum(left[:, None] - edges[:-1], np.minimum(left[:, None], 0) * (edges[:-1] == 0)), mode.lines), 0)
    fine, last, carried = np.zeros_like(pulses), np.zeros_like(pulses), np.zeros(count, np.int64)
    for j in range(n):
        now, lines = inside[:, j], int(mode.lines[j]) << mode.scale
        given = pulses[:, j] + carried
        if lines > 1:
            excess = np.maximum(given - mode.cap[j], 0)
            kept = given - excess
            parts = c * lines + ((dual == 0) & (j < intensity) if c == 2 and lines > 2 else 0)
            logs = parts * (LOG_WIDTHS[j] + (mode.scale << 3))
            offset = (logs >> 1) - parts * FINE_OFFSET + (parts << 3 >> 2 if lines == 2 else 0)
            offset = offset + np.where(kept + offset < parts << 4, logs >> 2, np.where(kept + offset < parts * 24, logs >> 3, 0))
            bits = np.maximum(kept + offset + (parts << 2), 0) // parts >> 3
            bits = np.minimum(np.where(c * bits > kept >> 3, kept >> stereo >> 3, bits), FINE_MOST)
            rounded = bits * (parts << 3) >= kept + offset
            kept = kept - (c * bits << 3)
        else:
            excess = np.maximum(given - base, 0)
            kept, bits, rounded = given - excess, np.zeros(count, np.int64), np.ones(count, bool)
        more = np.where(excess > 0, np.minimum(excess >> (3 + stereo), FINE_MOST - bits), 0)
        rounded = np.where(excess > 0, more * c << 3 >= excess - carried, rounded)
        # bands that were dropped spend their floor on fine bits
        idle = pulses[:, j] >> stereo >> 3
        fine[:, j] = np.where(now, bits + more, idle)
        last[:, j] = np.where(now, rounded, idle < 1)
        pulses[:, j] = np.where(now, kept, 0)
        carried = np.where(now, excess - (more * c << 3), carried)
    return {"coded": coded, "intensity": intensity, "dual": dual, "side": side + shared + both, "balance": carried, "pulses": pulses, "fine": fine, "priority": last}


_SINGLE, _BANDS = ("coded", "intensity", "dual", "side", "balance"), ("pulses", "fine", "priority")


def allocations(df: DataFrame, columns: Sequence[str], out: str, mode: Mode) -> DataFrame:
    """Adds a struct of the allocation; ``columns``: total, trim, offsets (21 integers), intensity, dual and bands coded before.

    Rows with a null in these, or with another number of offsets, get null.  No shuffle.
    """
    names, n = df.columns, len(mode.lines)
    kind = pa.struct([(f, pa.int64()) for f in _SINGLE] + [(f, pa.list_(pa.int64())) for f in _BANDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, trim, offsets, *rest = (batch.column(names.index(c)) for c in columns)
            right = np.ones(batch.num_rows, bool)
            for column in (total, trim, offsets, *rest):
                right &= column.is_valid().to_numpy(zero_copy_only=False)
            right &= offsets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == n
            at = np.flatnonzero(right)
            whole = lambda a: a.take(pa.array(at)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            flat = offsets.take(pa.array(at)).flatten().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, n)
            made = allocate(whole(total), whole(trim), flat, *(whole(a) for a in rest), mode)
            place = pa.array(np.where(right, np.cumsum(right) - 1, 0), mask=~right)
            single = [pa.array(made[f], pa.int64()).take(place) for f in _SINGLE]
            ends = pa.array(np.arange(len(at) + 1) * n, pa.int32())
            bands = [pa.ListArray.from_arrays(ends, pa.array(made[f].astype(np.int64).ravel())).take(place) for f in _BANDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(single + bands, fields=list(kind), mask=pa.array(~right))], names=[*names, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    added = ", ".join([f"{f}: bigint" for f in _SINGLE] + [f"{f}: array<bigint>" for f in _BANDS])
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` struct<{added}>"]))
