"""The floor fit against a plain version that goes post by post and bin by bin."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cadenza.operators import floorfit as K

POSTS = (0, 64, 32, 16, 48, 8, 24, 40, 56, 4, 60)


def even(x):
    low = math.floor(x)
    return low if x - low < Fraction(1, 2) else low + 1 if x - low > Fraction(1, 2) else low + low % 2


def least_squares(divisions, level, heard, n):
    s = [Fraction(0)] * 5
    for a, b in divisions:
        own = [i for i in range(a, min(b, n - 1) + 1) if level[i]]
        loud = sum(heard[i] for i in own)
        w = Fraction(len(own), loud + 1) + 1
        for i in own:
            m = w if heard[i] else 1
            s = [t + m * v for t, v in zip(s, (1, i, i * i, level[i], i * level[i]), strict=True)]
    c, x, xx, y, xy = s
    d = c * xx - x * x
    if d <= 0:
        return 0, 0, True
    a, b = (y * xx - xy * x) / d, (c * xy - x * y) / d
    return *(min(max(even(a + b * p), 0), 1023) for p in (divisions[0][0], divisions[-1][1])), False


def bent(x0, x1, y0, y1):
    out, err, y = [], 0, y0
    base = int((y1 - y0) / (x1 - x0))
    rest, step = abs(y1 - y0) - abs(base) * (x1 - x0), base - 1 if y1 < y0 else base + 1
    for x in range(x0, x1):
        if x > x0:
            err += rest
            y += step if err >= x1 - x0 else base
            err -= (x1 - x0) if err >= x1 - x0 else 0
        out.append(y)
    return out


def plain(line, mask, posts, rules):
    n = posts[1]
    level = [min(max(int(m * 7.3142857 + 1023.5), 0), 1023) for m in mask]
    heard = [f + rules.margin >= m for f, m in zip(line, mask, strict=True)]
    order = sorted(posts)
    spans = list(zip(order, order[1:], strict=False))
    value = {}
    first, last, _ = least_squares(spans, level, heard, n)
    value[0], value[1] = [first, first], [last, last]
    used, seen = [0, 1], set()
    mid = lambda p: value[p][1] if value[p][0] < 0 else value[p][0] if value[p][1] < 0 else (value[p][0] + value[p][1]) >> 1
    for i in range(2, len(posts)):
        lo = max((p for p in used if posts[p] < posts[i]), key=lambda p: posts[p])
        hi = min((p for p in used if posts[p] > posts[i]), key=lambda p: posts[p])
        if (lo, hi) in seen:
            continue
        seen.add((lo, hi))
        x0, x1 = posts[lo], posts[hi]
        curve = bent(x0, x1, mid(lo), mid(hi))
        far = any(heard[x] and (level[x] or x == x0) and (y + rules.over < level[x] or y - rules.under > level[x]) for x, y in zip(range(x0, x1), curve, strict=True))
        if not far:
            if max(rules.over, rules.under) ** 2 / (x1 - x0) > rules.error:
                continue
            if sum((y - level[x]) ** 2 for x, y in zip(range(x0, x1), curve, strict=True)) // (x1 - x0) <= rules.error:
                continue
        left = least_squares([s for s in spans if x0 <= s[0] < posts[i]], level, heard, n)
        right = least_squares([s for s in spans if posts[i] <= s[0] < x1], level, heard, n)
        if left[2] and right[2]:
            continue
        a0, a1 = (mid(lo), right[0]) if left[2] else left[:2]
        b0, b1 = (a1, mid(hi)) if right[2] else right[:2]
        value[lo][1] = a0
        value[0][0] = a0 if lo == 0 else value[0][0]
        value[i] = [a1, b0]
        value[hi][0] = b1
        value[1][1] = b1 if hi == 1 else value[1][1]
        used.append(i)
    out = [mid(0), mid(1)]
    for i, (a, b) in enumerate(K.neighbours(posts), 2):
        ya, yb = out[a] % K.PREDICTED, out[b] % K.PREDICTED
        guess = ya + (1 if yb >= ya else -1) * (abs(yb - ya) * (posts[i] - posts[a]) // (posts[b] - posts[a]))
        out.append(mid(i) if i in value and mid(i) != guess else guess | K.PREDICTED)
    return out, any(h and v for h, v in zip(heard, level, strict=True))


@pytest.mark.parametrize("rules", [K.FitRules(), K.FitRules(over=10, under=8, error=20), K.FitRules(margin=-5)])
def test_fit(rules):
    rng = np.random.default_rng(7)
    lines = np.cumsum(rng.normal(0, 6, (60, 64)), 1) - 60
    mask = np.round(np.array([np.convolve(r, np.ones(5) / 5, "same") for r in lines]), 3)
    lines[0], mask[0] = -200, -150
    mask[1, 20:40] = -150
    found, held = K.fit(lines, mask, POSTS, rules)
    for r in range(len(lines)):
        assert (found[r].tolist(), held[r]) == plain(lines[r].tolist(), mask[r].tolist(), POSTS, rules)
    assert not held[0] and (found[held] < K.PREDICTED).sum() > 2 * held.sum()


def test_points():
    for x1, y0, y1 in ((7, 3, 12), (7, 12, 3), (3, 0, 100), (5, 4, 4), (9, 100, 98)):
        x = np.arange(2, 2 + x1)
        found = K.line_points(*(np.array([v]) for v in (2, 2 + x1, y0, y1)), x)
        assert found.tolist() == bent(2, 2 + x1, y0, y1)


def test_bounds_hold_where_all_is_heard():
    """A mask of two straight parts is met to within a level at every bin."""
    mask = np.concatenate([np.linspace(-90, -30, 32), np.linspace(-30, -100, 32)])[None, :]
    posts, held = K.fit(mask, mask, POSTS)
    at = sorted(range(len(POSTS)), key=lambda p: POSTS[p])
    floor = np.interp(np.arange(64), [POSTS[p] for p in at], [posts[0, p] % K.PREDICTED for p in at])
    assert held[0] and np.abs(floor - K.levels(mask)[0]).max() <= 40


def test_neighbours():
    assert K.neighbours((0, 64, 32, 16, 48)) == [(0, 1), (0, 2), (2, 1)]
