"""Fit of a piecewise-linear floor to a mask: lines by least squares, split at posts where the error is too large.

Posts are visited in their order, and at each all rows of a matrix of spectra are split
that must be, so nothing loops over rows.  A line over a range of divisions is fitted
from differences of summed moments, and the points of an integer line have a closed form.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: A post without a value, and the mark of a post that its neighbours predict.
UNSET, PREDICTED = -200, 0x8000


@dataclass(frozen=True)
class FitRules:
    """How far a floor may lie over and under the mask, the mean square of errors allowed, and what counts as audible."""

    over: float = 60.0
    under: float = 30.0
    error: float = 500.0
    weight: float = 1.0
    margin: float = 18.0


def levels(db: np.ndarray) -> np.ndarray:
    """Decibels as whole numbers from 0 to 1023."""
    return np.clip(np.trunc(db * 7.3142857 + 1023.5), 0, 1023).astype(np.int64)


def line_points(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer lines at x: steps of the quotient, and one more whenever the remainders add up to a run."""
    run, rise = np.maximum(x1 - x0, 1), y1 - y0
    base = np.sign(rise) * (np.abs(rise) // run)
    rest = np.abs(rise) - np.abs(base) * run
    return y0 + (x - x0) * base + np.where(rise < 0, -1, 1) * ((x - x0) * rest // run)


def interpolated(x0, x1, y0, y1, x):
    """A point between two, rounded towards the first."""
    rise = y1 - y0
    return y0 + np.sign(rise) * (np.abs(rise) * (x - x0) // (x1 - x0))


def neighbours(posts: Sequence[int]) -> list[tuple[int, int]]:
    """For each post from the third on, the nearest ones below and above it among those before it."""
    out = []
    for i in range(2, len(posts)):
        before = range(i)
        out.append((max((j for j in before if posts[j] < posts[i]), key=lambda j: posts[j]), min((j for j in before if posts[j] > posts[i]), key=lambda j: posts[j])))
    return out


class _Moments:
    """Weighted sums of the divisions between neighbouring posts, summed up over divisions."""

    def __init__(self, level: np.ndarray, audible: np.ndarray, places: Sequence[int], rules: FitRules):
        rows, n = level.shape
        x = np.arange(n)
        parts = np.zeros((5, rows, len(places)))
        self.heard = np.zeros(rows, np.int64)
        for k, (a, b) in enumerate(zip(places, places[1:], strict=False)):
            own = slice(a, min(b, n - 1) + 1)
            y, xs = level[:, own], x[own]
            held = y != 0
            loud, soft = held & audible[:, own], held & ~audible[:, own]
            sums = lambda m, y=y, xs=xs: np.stack([(m * v).sum(1) for v in (1, xs, xs * xs, y, xs * y)])
            count = loud.sum(1)
            w = held.sum(1) * rules.weight / (count + 1.0) + 1.0
            parts[:, :, k + 1] = sums(soft) + sums(loud) * w
            self.heard += count
        self.sums, self.places = np.cumsum(parts, 2), np.asarray(places)

    def line(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels at both ends of the least-squares line over divisions start ... end - 1, and whether there is none.

        Levels are taken to six digits first, so that halves are halves however sums were made, and then to the even whole.
        """
        every = np.arange(self.sums.shape[1])
        n, x, xx, y, xy = self.sums[:, every, end] - self.sums[:, every, start]
        d = n * xx - x * x
        none = d <= 0
        safe = np.where(none, 1.0, d)
        a, b = (y * xx - xy * x) / safe, (n * xy - x * y) / safe
        at = lambda place: np.where(none, 0, np.clip(np.rint(np.round(a + b * place, 6)), 0, 1023)).astype(np.int64)
        return at(self.places[start]), at(self.places[end]), none


def _too_far(level: np.ndarray, audible: np.ndarray, x0, x1, y0, y1, rules: FitRules) -> np.ndarray:
    x = np.arange(level.shape[1])
    inside = (x >= x0[:, None]) & (x < x1[:, None])
    y = line_points(x0[:, None], x1[:, None], y0[:, None], y1[:, None], x)
    judged = inside & audible & ((level != 0) | (x == x0[:, None]))
    far = (judged & ((y + rules.over < level) | (y - rules.under > level))).any(1)
    n = np.maximum(x1 - x0, 1)
    mean = np.where(inside, (y - level) ** 2, 0).sum(1) // n
    short = (rules.over**2 / n > rules.error) | (rules.under**2 / n > rules.error)
    return far | (~short & (mean > rules.error))


def fit(lines: np.ndarray, mask: np.ndarray, posts: Sequence[int], rules: FitRules | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, post) levels of the floor, marked where neighbours predict them, and whether a row has a floor at all.

    ``posts`` are places on the spectrum: 0, its end, then the others in order of splitting.
    """
    rules = rules or FitRules()
    rows, count, n = len(lines), len(posts), posts[1]
    order = sorted(range(count), key=lambda k: posts[k])
    sorted_at = {post: k for k, post in enumerate(order)}
    rank = np.array([sorted_at[p] for p in range(count)])
    place = np.array(posts)
    level, audible = levels(mask[:, :n]), lines[:, :n] + rules.margin >= mask[:, :n]
    moments = _Moments(level, audible, [posts[p] for p in order], rules)
    every = np.arange(rows)
    low_value, high_value = np.full((rows, count), UNSET), np.full((rows, count), UNSET)  # from the left, from the right
    below, above = np.zeros((rows, count), np.int64), np.ones((rows, count), np.int64)
    seen = np.full((rows, count), -1)

    def value(p: np.ndarray) -> np.ndarray:
        a, b = low_value[every, p], high_value[every, p]
        return np.where(a < 0, b, np.where(b < 0, a, (a + b) >> 1))

    first, last, _ = moments.line(np.zeros(rows, np.int64), np.full(rows, count - 1))
    low_value[:, 0] = high_value[:, 0] = first
    low_value[:, 1] = high_value[:, 1] = last
    for i in range(2, count):
        at = rank[i]
        lo, hi = below[:, at], above[:, at]
        fresh = seen[every, lo] != hi
        seen[every[fresh], lo[fresh]] = hi[fresh]
        ly, hy = value(lo), value(hi)
        split = fresh & _too_far(level, audible, place[lo], place[hi], ly, hy, rules)
        here = np.full(rows, at)
        ly0, ly1, no_left = moments.line(rank[lo], here)
        hy0, hy1, no_right = moments.line(here, rank[hi])
        ly0, ly1 = np.where(no_left, ly, ly0), np.where(no_left, hy0, ly1)
        hy0, hy1 = np.where(no_right, ly1, hy0), np.where(no_right, hy, hy1)
        split &= ~(no_left & no_right)
        r = every[split]
        high_value[r, lo[r]] = ly0[r]
        low_value[r[lo[r] == 0], 0] = ly0[r[lo[r] == 0]]
        low_value[r, i], high_value[r, i] = ly1[r], hy0[r]
        low_value[r, hi[r]] = hy1[r]
        high_value[r[hi[r] == 1], 1] = hy1[r[hi[r] == 1]]
        used = split & ((ly1 >= 0) | (hy0 >= 0))
        above[:, :at] = np.where(used[:, None] & (above[:, :at] == hi[:, None]), i, above[:, :at])
        below[:, at + 1 :] = np.where(used[:, None] & (below[:, at + 1 :] == lo[:, None]), i, below[:, at + 1 :])
    out = np.zeros((rows, count), np.int64)
    out[:, 0], out[:, 1] = value(np.zeros(rows, np.int64)), value(np.ones(rows, np.int64))
    for i, (a, b) in enumerate(neighbours(posts), 2):
        guess = interpolated(posts[a], posts[b], out[:, a] & (PREDICTED - 1), out[:, b] & (PREDICTED - 1), posts[i])
        own = value(np.full(rows, i))
        out[:, i] = np.where((own >= 0) & (own != guess), own, guess | PREDICTED)
    return out, moments.heard > 0
