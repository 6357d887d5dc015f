"""Coarse band energies of the low-delay codec: predicted from the last frame or not, whichever costs less.

A frame's energies are coded as whole steps of a prediction, so each frame needs the one
before it as it was decoded.  The fold carries a vector for each stream, and goes over the
n-th frames of all streams of a batch at once; what a range coder would have spent is
followed exactly without writing its bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import ranked_fold

#: Mean levels of bands, in octaves of amplitude; fixed values of the codec.
MEANS = (6.4375, 6.25, 5.75, 5.3125, 5.0625, 4.8125, 4.5, 4.375, 4.875, 4.6875, 4.5625, 4.4375, 4.875, 4.625, 4.3125, 4.5, 4.375, 4.625, 4.75, 4.4375, 3.75, 3.75, 3.75, 3.75, 3.75)
#: Share of the last frame and of the lower band's step that go into a prediction, by size of frame; fixed values of the codec.
KEPT = (29440 / 32768, 26112 / 32768, 21248 / 32768, 16384 / 32768)
LEAK = (30147 / 32768, 22282 / 32768, 12124 / 32768, 6554 / 32768)
LEAK_ALONE = 4915 / 32768
#: Mantissas from which the next eighth of a bit counts as spent; fixed values of the codec.
EIGHTHS = (35733, 38967, 42495, 46340, 50535, 55109, 60097, 65535)
#: Frequencies of a coder add up to two to this power, and this many of the rarest steps keep a place on either side.
LAPLACE_BITS, LAPLACE_LEAST = 15, 16
#: Fewer frames at once than these are gone over number by number, which is quicker than arrays of a few.
FEW = 24


def ruled_shapes(bands: int) -> np.ndarray:
    """Probability of zero and decay of each band's steps by a rule, where the caller has none; predicted frames first."""
    b = np.arange(bands)
    return np.array([[60 + 5 * b, 110 - 4 * b], [30 + 4 * b, 170 - 6 * b]]).transpose(0, 2, 1)


def laplace(zero: int, decay: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Start and size of the places of steps of 1, 2, ... downwards, each followed by its like upwards; least and largest step."""
    whole, starts, sizes = 1 << LAPLACE_BITS, [], []
    at, more = zero, (whole - 2 * LAPLACE_LEAST - zero) * (16384 - decay) >> LAPLACE_BITS
    while at < whole:
        starts.append(at)
        sizes.append(more + 1)
        at, more = at + 2 * (more + 1), 2 * more * decay >> LAPLACE_BITS
    up = len(starts) if starts[-1] + sizes[-1] < whole else len(starts) - 1
    return np.array(starts), np.array(sizes), -len(starts), up


@dataclass(frozen=True)
class Energies:
    """Shapes (predicted or alone, band, probability of zero and decay in 8 bits), channels, and the logarithm of the frame's size in shortest frames.

    ``both`` tries either way and keeps the better; without it a frame stands alone after much
    change.  ``loss`` is the percentage of lost packets that is reckoned with, ``bass`` is for
    a channel of low effects.
    """

    shapes: np.ndarray
    channels: int = 1
    scale: int = 0
    both: bool = True
    loss: int = 0
    bass: bool = False

    def __post_init__(self):
        zero, decay = np.moveaxis(np.asarray(self.shapes), -1, 0)
        if np.ndim(self.shapes) != 3 or len(self.shapes) != 2 or (zero < 1).any() or (zero > 255).any() or (decay < 0).any() or (decay > 179).any():
            raise ValueError("shapes hold a probability of zero from 1 to 255 and a decay from 0 to 179 for either way and each band")

    @property
    def bands(self) -> int:
        return np.shape(self.shapes)[1]

    @cached_property
    def places(self) -> list[list[tuple[int, np.ndarray, np.ndarray, int, int]]]:
        return [[(int(z) << 7, *laplace(int(z) << 7, int(d) << 6)) for z, d in way] for way in np.asarray(self.shapes)]

    @cached_property
    def plain_places(self) -> list[list[tuple[int, list[int], list[int], int, int]]]:
        return [[(zero, starts.tolist(), sizes.tolist(), least, most) for zero, starts, sizes, least, most in way] for way in self.places]


class Spent:
    """Bits that range coders have spent: their ranges and the bits shifted out, a pair for each row."""

    def __init__(self, rows: int):
        self.range, self.bits = np.full(rows, 1 << 31, np.int64), np.full(rows, 33, np.int64)

    def code(self, low: np.ndarray, size: np.ndarray, bits: np.ndarray, where: np.ndarray) -> None:
        """A symbol of ``size`` places from ``low`` on out of two to the power of ``bits``, where there is one."""
        unit = self.range >> bits
        made = np.where(low > 0, unit * size, self.range - unit * ((1 << bits) - low - size))
        made = np.where(where, made, self.range)
        shift = 8 * ((made <= 1 << 23).astype(np.int64) + (made <= 1 << 15) + (made <= 1 << 7))
        self.range, self.bits = made << shift, self.bits + shift

    def _length(self) -> np.ndarray:
        return np.frexp(self.range.astype(float))[1].astype(np.int64)

    def whole(self) -> np.ndarray:
        return self.bits - self._length()

    def eighths(self) -> np.ndarray:
        n = self._length()
        mantissa = self.range >> (n - 16)
        part = (mantissa >> 12) - 8
        return 8 * (self.bits - n) - part - (mantissa > np.array(EIGHTHS)[part])


def _way(x: np.ndarray, old: np.ndarray, budget: np.ndarray, fall: np.ndarray, mode: Energies, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps, what they leave, decoded energies, how far steps were bent by the budget, and eighths spent, for frames coded one way."""
    kept, leak = (0.0, LEAK_ALONE) if alone else (KEPT[mode.scale], LEAK[mode.scale])
    spent, n = Spent(len(x)), mode.bands
    flag = np.full(len(x), int(alone))
    spent.code(7 * flag, np.where(flag, 1, 7), np.full(len(x), 3), budget >= 4)
    steps, left, now = np.zeros(x.shape, np.int64), np.zeros(x.shape), np.zeros(x.shape)
    bent, below = np.zeros(len(x), np.int64), np.zeros((len(x), mode.channels))
    for band in range(n):
        zero, starts, sizes, least, most = mode.places[int(alone)][band]
        for channel in range(mode.channels):
            at = channel * n + band
            e, last = x[:, at], np.maximum(old[:, at], -9.0)
            off = e - kept * last - below[:, channel]
            floor = np.maximum(old[:, at], -28.0) - fall
            q = np.floor(0.5 + off).astype(np.int64)
            q = wanted = np.where((q < 0) & (e < floor), np.minimum(q + np.trunc(np.maximum(floor - e, 0)).astype(np.int64), 0), q)
            room = budget - spent.whole()
            if band:
                spare = room - 3 * mode.channels * (n - band)
                q = np.where(spare < 24, np.minimum(q, 1), q)
                q = np.where(spare < 16, np.maximum(q, -1), q)
            if mode.bass and band >= 2:
                q = np.minimum(q, 0)
            q = np.select([room >= 15, room >= 2, room >= 1], [np.clip(q, least, most), np.clip(q, -1, 1), np.minimum(q, 0)], -1)
            place = np.clip(abs(q), 1, len(starts)) - 1
            low = np.select([room >= 15, room >= 2], [np.where(q == 0, 0, starts[place] + np.where(q > 0, sizes[place], 0)), np.where(q == 0, 0, np.where(q < 0, 2, 3))], q < 0)
            size = np.select([room >= 15, room >= 2], [np.where(q == 0, zero, sizes[place]), np.where(q == 0, 2, 1)], 1)
            spent.code(low, size, np.select([room >= 15, room >= 2], [LAPLACE_BITS, 2], 1), room >= 1)
            steps[:, at], left[:, at], now[:, at] = q, off - q, kept * last + below[:, channel] + q
            bent += abs(wanted - q)
            below[:, channel] = below[:, channel] + q - leak * q
    return steps, left, now, np.zeros_like(bent) if mode.bass else bent, spent.eighths()


def _spend(span: int, bits: int, low: int, size: int, places: int) -> tuple[int, int]:
    """What ``Spent.code`` does, for one coder."""
    unit = span >> places
    span = unit * size if low else span - unit * ((1 << places) - size)
    while span <= 1 << 23:
        span, bits = span << 8, bits + 8
    return span, bits


def _one_way(x: list[float], old: list[float], budget: int, fall: float, mode: Energies, alone: bool) -> tuple[list[int], list[float], list[float], int, int]:
    """What ``_way`` does, for one frame."""
    kept, leak = (0.0, LEAK_ALONE) if alone else (KEPT[mode.scale], LEAK[mode.scale])
    n, channels, span, bits = mode.bands, mode.channels, 1 << 31, 33
    if budget >= 4:
        span, bits = _spend(span, bits, 7, 1, 3) if alone else _spend(span, bits, 0, 7, 3)
    steps, left, now, below, bent = [0] * len(x), [0.0] * len(x), [0.0] * len(x), [0.0] * channels, 0
    for band, (zero, starts, sizes, least, most) in enumerate(mode.plain_places[int(alone)]):
        for channel in range(channels):
            at = channel * n + band
            e, last = x[at], max(old[at], -9.0)
            off = e - kept * last - below[channel]
            q, floor = math.floor(0.5 + off), max(old[at], -28.0) - fall
            if q < 0 and e < floor:
                q = min(q + int(floor - e), 0)
            wanted, room = q, budget - bits + span.bit_length()
            if band:
                spare = room - 3 * channels * (n - band)
                q = min(q, 1) if spare < 24 else q
                q = max(q, -1) if spare < 16 else q
            if mode.bass and band >= 2:
                q = min(q, 0)
            if room >= 15:
                q = min(max(q, least), most)
                k = abs(q) - 1
                span, bits = _spend(span, bits, 0, zero, LAPLACE_BITS) if q == 0 else _spend(span, bits, starts[k] + (sizes[k] if q > 0 else 0), sizes[k], LAPLACE_BITS)
            elif room >= 2:
                q = min(max(q, -1), 1)
                span, bits = _spend(span, bits, 0, 2, 2) if q == 0 else _spend(span, bits, 2 if q < 0 else 3, 1, 2)
            elif room >= 1:
                q = min(q, 0)
                span, bits = _spend(span, bits, int(q < 0), 1, 1)
            else:
                q = -1
            steps[at], left[at], now[at] = q, off - q, kept * last + below[channel] + q
            bent += abs(wanted - q)
            below[channel] = below[channel] + q - leak * q
    mantissa = span >> span.bit_length() - 16
    part = (mantissa >> 12) - 8
    return steps, left, now, 0 if mode.bass else bent, 8 * (bits - span.bit_length()) - part - (mantissa > EIGHTHS[part])


def frames(states: np.ndarray, x: np.ndarray, octets: np.ndarray, forced: np.ndarray, mode: Energies) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The next states and what was coded, for one frame of each of many streams; a state is decoded energies and gathered change."""
    old, change = states[:, :-1], states[:, -1]
    size, budget = mode.bands * mode.channels, 8 * octets
    fall = np.minimum(16.0, 0.125 * octets) if mode.bands > 10 else np.full(len(x), 16.0)
    fall = np.full(len(x), 3.0) if mode.bass else fall
    if 0 < len(x) < FEW:
        given = list(zip(x.tolist(), old.tolist(), budget.tolist(), fall.tolist(), strict=True))
        ways = [tuple(np.array(v) for v in zip(*(_one_way(*g, mode, alone) for g in given), strict=True)) for alone in (False, True)]
    else:
        ways = [_way(x, old, budget, fall, mode, alone) for alone in (False, True)]
    (*_, bent, spent), (*_, bent_alone, spent_alone) = ways
    told = budget >= 4
    must = told & (forced | ((not mode.both) & (change > 2.0 * size) & (octets > size)))
    bias = budget * np.trunc(change).astype(np.int64) * mode.loss // (mode.channels * 512)
    better = (bent_alone < bent) | ((bent_alone == bent) & (spent + bias > spent_alone))
    alone = must | (told & mode.both & better)
    made = {k: np.where(alone[:, None] if a.ndim > 1 else alone, b, a) for k, a, b in zip(("steps", "left", "energies", "bent", "eighths"), *ways, strict=True)}
    moved = np.minimum(200.0, np.add.accumulate((x - old) ** 2, axis=1)[:, -1])
    gathered = np.where(alone, moved, KEPT[mode.scale] ** 2 * change + moved)
    return np.column_stack([made["energies"], gathered]), made | {"alone": alone}


def coarse(df: DataFrame, key: str, order: str, energies: str, octets: str, mode: Energies, forced: str | None = None) -> DataFrame:
    """key, order, ``alone``, ``eighths`` (bits spent, in eighths), ``steps``, ``left`` and ``energies`` of each frame of each stream.

    ``energies`` holds the octaves above the means, channel after channel; ``octets`` is what
    a frame may take.  A frame with a null, a value that is no number, a wrong count of bands
    or a negative size gives nulls and leaves the state as it is; frames of null key are a
    stream of their own; places in a stream are distinct.  Streams run side
    by side; one stream's frames stream through one task, as each needs the one before it.
    """
    n = mode.bands * mode.channels
    lists, flat = pa.list_(pa.int64()), pa.list_(pa.float64())

    def spread(values: np.ndarray, good: np.ndarray, kind: pa.ListType) -> pa.Array:
        ends = np.append(0, np.cumsum(np.where(good, n, 0))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~good, False)), pa.array(values.ravel(), kind.value_type))

    def step(states: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, list]:
        good = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
        x = rows.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        size, force = (rows.column(k).filter(pa.array(good)).to_numpy(zero_copy_only=False) for k in (1, 2))
        states[good], made = frames(states[good], x, size.astype(np.int64), force.astype(bool), mode)
        one = lambda values, kind: pa.array(_placed(values, good), kind, mask=~good)
        return states, [one(made["alone"], pa.bool_()), one(made["eighths"], pa.int64()), spread(made["steps"], good, lists), spread(made["left"], good, flat), spread(made["energies"], good, flat)]

    whole = F.col(octets).cast("long")
    fine = (F.size(energies) == n) & F.forall(energies, lambda v: F.coalesce(v.between(-1e6, 1e6), F.lit(False))) & (whole >= 0)
    force = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = df.select(key, order, F.when(fine, F.col(energies).cast("array<double>")).alias("x"), whole.alias("size"), force.alias("force"))
    return ranked_fold(rows, key, order, np.zeros(n + 1), step, "alone boolean, eighths long, steps array<long>, `left` array<double>, energies array<double>")


def _placed(values: np.ndarray, good: np.ndarray) -> np.ndarray:
    out = np.zeros(len(good), values.dtype)
    out[good] = values
    return out
