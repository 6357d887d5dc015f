"""Tone seeds on octave lines, the noise floor over Bark windows, and the full mask of a spectrum.

All functions take matrices, one spectrum in decibels to a row, and work on every row at
once: loops run over the lines of a spectrum, never over its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: No seed on a line; bands, levels and points of the curves, and the point of the masker itself; fixed values of the model.
NONE = -9999.0
BANDS, LEVELS, FIRST_LEVEL, POINTS, CENTRE = 17, 8, 30.0, 56, 16
REACH, LOUDEST, SEED_LIMIT = 6.0, 105.0, -40.0


@dataclass(frozen=True)
class OctaveMap:
    """The octave line of each bin: ``per`` lines to an eighth of an octave."""

    bins: int
    rate: int
    per: int

    @property
    def shift(self) -> int:
        return round(math.log2(self.per * 8)) - 1

    def _at(self, bin: float) -> float:
        return (math.log(bin * 0.5 * self.rate / self.bins) * 1.442695 - 5.965784) * (1 << (self.shift + 1))

    @property
    def first(self) -> int:
        return int(self._at(0.25) - self.per)

    @property
    def lines(self) -> int:
        return int(self._at(self.bins + 0.25) + 0.5) - self.first + 1

    @property
    def octaves(self) -> list[int]:
        return [int(self._at(i + 0.25) + 0.5) for i in range(self.bins)]

    def runs(self) -> list[tuple[int, int, int]]:
        """(octave, first bin, last bin) of bins that share a line."""
        out: list[tuple[int, int, int]] = []
        for i, oc in enumerate(self.octaves):
            out[-1:] = [(oc, out[-1][1], i)] if out and out[-1][0] == oc else [*out[-1:], (oc, i, i)]
        return out

    def spans(self) -> list[tuple[int, int, int, int]]:
        """(first line, last line, first bin, bin after) by which chased lines are read back to bins."""
        octaves, out = self.octaves, []
        at, line = 0, octaves[0] - self.first - (self.per >> 1)
        while at + 1 < self.bins:
            last = max(line, ((octaves[at] + octaves[at + 1]) >> 1) - self.first)
            end = next((k for k in range(at, self.bins) if octaves[k] > last + self.first), self.bins)
            out.append((line, last, at, end))
            at, line = end, last
        return out


def ruled_curves() -> np.ndarray:
    """(band, level, point) in decibels about the masker, by a rule: slopes of 6 dB below and 3 to 1.25 dB above; -inf where a curve ends."""
    band, level, point = np.ogrid[:BANDS, :LEVELS, :POINTS]
    away = point - CENTRE
    curve = -(12 + 0.5 * band) - np.where(away > 0, (3 - 0.25 * level) * away, -6 * away)
    return np.where((away >= -6 - level) & (away < 10 + 3 * level), curve, -np.inf)


def seeds(f: np.ndarray, floor: np.ndarray, octaves: OctaveMap, curves: np.ndarray) -> np.ndarray:
    """The loudest curve on each octave line, of the peaks that rise to within 6 dB of the floor."""
    out = np.full((len(f), octaves.lines), NONE)
    shift = LOUDEST - f.max(1)
    for oc, start, end in octaves.runs():
        peak = f[:, start : end + 1].max(1)
        heard = peak + REACH > floor[:, end]
        level = np.clip(np.floor((peak + shift - FIRST_LEVEL) * 0.1), 0, LEVELS - 1).astype(int)
        curve = curves[min(max(oc >> octaves.shift, 0), BANDS - 1)][level]
        lines = oc - octaves.first + (np.arange(POINTS) - CENTRE) * octaves.per - (octaves.per >> 1)
        own = (lines > 0) & (lines < octaves.lines)
        raised = np.where(heard[:, None], peak[:, None] + curve[:, own], -np.inf)
        out[:, lines[own]] = np.maximum(out[:, lines[own]], raised)
    return out


def chase(seed: np.ndarray, per: int) -> np.ndarray:
    """Seeds that no later, louder one within ``per`` lines covers, each held until the next louder one or ``per`` lines on.

    Every row has its own stack of (line, level); the stacks are columns of two matrices,
    and a step pops from all rows that must pop.
    """
    rows, n = seed.shape
    every = np.arange(rows)
    place, level, size = np.zeros((rows, n), np.int64), np.zeros((rows, n)), np.zeros(rows, np.int64)
    for i in range(n):
        now = seed[:, i]
        while True:
            top, under = np.maximum(size - 1, 0), np.maximum(size - 2, 0)
            last, before = level[every, top], level[every, under]
            pop = (size > 1) & (now >= last) & (i < place[every, top] + per) & (last <= before) & (i < place[every, under] + per)
            if not pop.any():
                break
            size -= pop
        place[every, size], level[every, size] = i, now
        size += 1
    held = np.arange(n) < size[:, None]
    ahead = np.concatenate([level[:, 1:], np.full((rows, 1), -np.inf)], 1)
    until = np.concatenate([place[:, 1:], np.zeros((rows, 1), np.int64)], 1)
    louder = (ahead > level) & (np.arange(n) < size[:, None] - 1)
    ends = np.where(held, np.clip(np.where(louder, until, place + per + 1), 0, n), 0)
    reached = np.maximum.accumulate(ends, 1)
    passed = np.zeros((rows, n + 1), np.int64)
    np.add.at(passed, (np.repeat(every, size), reached[held]), 1)
    owner = np.cumsum(passed[:, :n], 1)
    return np.where(owner < size[:, None], np.take_along_axis(level, np.minimum(owner, n - 1), 1), seed)


def scattered(chased: np.ndarray, floor: np.ndarray, octaves: OctaveMap, limit: float = SEED_LIMIT) -> np.ndarray:
    """The floor raised to the least seed over each bin's lines."""
    out, at = floor.copy(), 0
    line = lambda k: chased[:, k] if 0 <= k < octaves.lines else np.full(len(chased), NONE)
    for first, last, start, end in octaves.spans():
        over = np.stack([np.minimum(line(first), limit), *(line(k) for k in range(first + 1, last + 1))], 1)
        least = np.where(over > NONE, over, np.inf).min(1)
        out[:, start:end] = np.maximum(out[:, start:end], np.where(np.isinf(least), NONE, least)[:, None])
        at = end
    out[:, at:] = np.maximum(out[:, at:], line(octaves.lines - 1)[:, None])
    return out


def tone_mask(f: np.ndarray, quiet: np.ndarray, octaves: OctaveMap, curves: np.ndarray, below: float = -140.0, least: float = -140.0) -> np.ndarray:
    """The threshold in quiet, hung below the loudest line, raised by the tone curves of all peaks."""
    floor = quiet + np.maximum(f.max(1) + below, least)[:, None]
    return scattered(chase(seeds(f, floor, octaves, curves), octaves.per), floor, octaves)


def noise_floor(f: np.ndarray, windows: Sequence[tuple[int, int]], offset: float = 140.0, fixed: int = 0) -> np.ndarray:
    """For each bin the value at it of a line fitted over its window, by running moments; with ``fixed``, the lower of that and one over so many bins.

    Weights are the squares of levels over -offset, at least 1.  Windows that start below
    zero are mirrored there; bins whose windows end past the spectrum go on along the last line.
    """
    rows, n = f.shape
    x = np.arange(n, dtype=np.float64)
    y = np.maximum(f + offset, 1.0)
    w = y * y
    terms = np.stack([w, w * x, w * x * x, w * y, w * x * y])
    terms[:, :, 0] = np.stack([w[:, 0] / 2, w[:, 0] / 2, 0 * w[:, 0], w[:, 0] / 2 * y[:, 0], 0 * w[:, 0]])
    sums = np.cumsum(terms, 2)
    mirrored = np.array([1.0, -1.0, 1.0, 1.0, -1.0])[:, None]

    def along(spans: Sequence[tuple[int, int]]) -> np.ndarray:
        out, line = np.zeros((rows, n)), None
        for i, (low, high) in enumerate(spans):
            if high < n and abs(low) < n:
                s = sums[:, :, high] + mirrored * sums[:, :, -low] if low < 0 else sums[:, :, high] - sums[:, :, low]
                line = s[3] * s[2] - s[1] * s[4], s[0] * s[4] - s[1] * s[3], s[0] * s[2] - s[1] * s[1]
            out[:, i] = (line[0] + i * line[1]) / line[2]
        return out

    found = np.maximum(along(windows), 0.0) - offset
    if fixed > 0:
        found = np.minimum(found, along([(i + fixed // 2 - fixed, i + fixed // 2) for i in range(n)]) - offset)
    return found


def log_mask(noise: np.ndarray, tone: np.ndarray, raised: np.ndarray, attenuation: float = 0.0, ceiling: float = 0.0) -> np.ndarray:
    """The louder of the noise floor, raised and capped, and the tone mask."""
    return np.maximum(np.minimum(noise + raised, ceiling), tone + attenuation)
