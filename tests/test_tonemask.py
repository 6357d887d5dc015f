"""Tone seeds, their chase and the noise floor, row by row in plain loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import curves as V
from cadenza.operators import tonemask as M

MAP = M.OctaveMap(64, 44100, 4)


def stack(seed, per):
    places, levels = [], []
    for i, now in enumerate(seed):
        while len(places) > 1 and now >= levels[-1] and i < places[-1] + per and levels[-1] <= levels[-2] and i < places[-2] + per:
            places.pop()
            levels.pop()
        places.append(i)
        levels.append(now)
    out, at = list(seed), 0
    for k, (p, v) in enumerate(zip(places, levels, strict=True)):
        louder = k + 1 < len(places) and levels[k + 1] > v
        for x in range(at, min(len(seed), places[k + 1] if louder else p + per + 1)):
            out[x] = v
            at = x + 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=12, max_size=12), min_size=1, max_size=5), st.integers(1, 5))
def test_chase(rows, per):
    seed = np.array(rows, float)
    assert M.chase(seed, per).tolist() == [stack(r, per) for r in seed.tolist()]


def test_a_lone_peak_is_held():
    seed = np.full((1, 30), M.NONE)
    seed[0, 10] = -20.0
    found = M.chase(seed, 4)[0]
    # What was held before reaches one line past the peak's own.
    assert found[11:15].tolist() == [-20.0] * 4 and found[10] == M.NONE and found[15] == M.NONE


def test_octaves():
    assert MAP.shift == 4 and len(MAP.octaves) == 64 and MAP.octaves == sorted(MAP.octaves)
    assert [(a, b) for _, a, b in MAP.runs()][0][0] == 0 and MAP.runs()[-1][2] == 63
    assert sum(b - a + 1 for _, a, b in MAP.runs()) == 64
    spans = MAP.spans()
    assert [s[2] for s in spans][1:] == [s[3] for s in spans][:-1] and [s[0] for s in spans][1:] == [s[1] for s in spans][:-1]


def levels(n=20):
    rng = np.random.default_rng(4)
    return np.round(rng.normal(-60, 15, (n, 64)), 2)


def test_seeds():
    f, curves = levels(), M.ruled_curves()
    floor = f.mean(1, keepdims=True) + np.zeros((1, 64))
    found = M.seeds(f, floor, MAP, curves)
    for r, row in enumerate(f.tolist()):
        want = [M.NONE] * MAP.lines
        for oc, a, b in MAP.runs():
            peak = max(row[a : b + 1])
            if peak + 6 > floor[r, b]:
                level = min(max(math.floor((peak + 105 - max(row) - 30) * 0.1), 0), 7)
                for k in range(M.POINTS):
                    line = oc - MAP.first + (k - 16) * 4 - 2
                    if 0 < line < MAP.lines:
                        want[line] = max(want[line], peak + curves[min(max(oc >> 4, 0), 16), level, k])
        assert found[r].tolist() == pytest.approx(want)


def test_scatter_raises_only():
    f = levels()
    quiet = np.linspace(-100, -40, 64)
    mask = M.tone_mask(f, quiet, MAP, M.ruled_curves())
    floor = quiet + np.maximum(f.max(1) - 140, -140)[:, None]
    assert (mask >= floor).all() and (mask > floor).any()
    chased = np.full((1, MAP.lines), M.NONE)
    assert M.scattered(chased, floor[:1], MAP).tolist() == floor[:1].tolist()
    first, last, a, b = MAP.spans()[5]
    chased[0, first : last + 1] = [-50 + k for k in range(last - first + 1)]
    assert M.scattered(chased, np.full((1, 64), -300.0), MAP)[0, a:b].tolist() == [-50.0] * (b - a)
    chased[0, first] = -10.0  # the limit holds for the first line of a span
    top = M.scattered(chased, np.full((1, 64), -300.0), MAP)[0, a]
    assert top == (-40.0 if last == first else min(-40.0, -49.0))


def test_noise_floor():
    f, windows = levels(6), V.bark_windows(64, 44100, 0.5, 0.5, 3, 4)
    for fixed in (0, 10):
        found = M.noise_floor(f, windows, 140.0, fixed)
        for r, row in enumerate(f):
            y = np.maximum(row + 140, 1)
            w, x = y * y, np.arange(64.0)
            terms = [w.copy(), w * x, w * x * x, w * y, w * x * y]
            terms[0][0] /= 2
            terms[1][0] = terms[0][0]
            terms[3][0] /= 2

            def line(spans, terms=terms):
                out, last = [], None
                for i, (low, high) in enumerate(spans):
                    if high < 64 and abs(low) < 64:
                        s = [t[: high + 1].sum() + (sign * t[: -low + 1].sum() if low < 0 else -t[: low + 1].sum()) for t, sign in zip(terms, (1, -1, 1, 1, -1), strict=True)]
                        last = np.linalg.solve([[s[0], s[1]], [s[1], s[2]]], [s[3], s[4]])
                    out.append(last[0] + last[1] * i)
                return np.array(out)

            want = np.maximum(line(windows), 0) - 140
            if fixed:
                want = np.minimum(want, line([(i - 5, i + 5) for i in range(64)]) - 140)
            assert found[r] == pytest.approx(want, abs=1e-6)


def test_mix():
    assert M.log_mask(np.array([[-10.0, 5.0]]), np.array([[-20.0, 1.0]]), np.array([2.0, 2.0])).tolist() == [[-8.0, 1.0]]
