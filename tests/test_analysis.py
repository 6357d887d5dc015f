"""Transients, octave errors, boosts and resampling, against plain loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.operators import boosts as B
from cadenza.operators import octaves as O
from cadenza.operators import resampling as S
from cadenza.operators import transients as N


def plain_metric(x, decay):
    before, older, y = 0.0, 0.0, []
    for v in x:
        out = before + v
        before, older = older + out - 2 * v, v - 0.5 * out
        y.append(out)
    y[:12] = [0.0] * min(12, len(y))
    half = len(x) // 2
    energy = [y[2 * i] ** 2 + y[2 * i + 1] ** 2 for i in range(half)]
    mask, level = [], 0.0
    for e in energy:
        level += decay * (e - level)
        mask.append(level)
    level = 0.0
    for i in reversed(range(half)):
        level += 0.125 * (mask[i] - level)
        mask[i] = level
    norm = half / (1e-15 + math.sqrt(sum(energy) * max(mask) * 0.5 * half))
    total = sum(N.INVERSE[min(127, math.floor(64 * norm * (mask[i] + 1e-15)))] for i in range(12, half - 5, 4))
    return 256 * total // (6 * (half - 17))


@pytest.mark.parametrize("size", [36, 63, 64, 200, 1153])
def test_metric(size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(6, size)) * np.exp(rng.normal(size=(6, 1)))
    x[1, : size // 2] *= 1e-4
    x[2] = 0
    for weak, decay in ((False, 0.0625), (True, 0.03125)):
        assert N.metric(x, weak).tolist() == [plain_metric(r.tolist(), decay) for r in x]


def test_recursive_filter_joins_blocks():
    x = np.random.default_rng(1).normal(size=(3, 300))
    whole, pieces = N.recursive(x, (1.0, 0.3), (-0.9, 0.2), 512), N.recursive(x, (1.0, 0.3), (-0.9, 0.2), 7)
    assert np.allclose(whole, pieces, atol=1e-12)
    y = np.zeros(300)
    for i in range(300):
        y[i] = x[0, i] + (0.3 * x[0, i - 1] + 0.9 * y[i - 1] if i else 0) - (0.2 * y[i - 2] if i > 1 else 0)
    assert np.allclose(whole[0], y, atol=1e-12)


def test_transient_rows(spark):
    rng = np.random.default_rng(7)
    click = np.zeros(960)
    click[700:] = np.sin(np.arange(260)) * 0.9
    hum = np.sin(np.arange(960) * 0.9)
    rows = [(1, hum.tolist(), hum.tolist()), (2, hum.tolist(), click.tolist()), (3, None, hum.tolist()), (4, [0.1] * 10, [0.1] * 10), (5, [], []), (6, [0.1] * 9, [0.1] * 8), (7, [None, *rng.normal(size=959).tolist()], [0.0] * 960)]
    df = spark.createDataFrame(rows, "id long, l array<double>, r array<double>")
    out = {r.id: r.t for r in N.transients(df, ["l", "r"], "t").collect()}
    assert not out[1].transient and out[1].channel == 0
    assert out[2].transient and out[2].channel == 1 and 0 < out[2].estimate < 1
    assert out[3] is None and out[6] is None
    assert out[4].metric == out[5].metric == 0
    assert out[7].metric == plain_metric([0.0, *rows[6][1][1:]], 0.0625)


def plain_resample(x, source, target):
    ratio = target / source
    cut = min(1.0, ratio)
    width = 16 / cut
    out = []
    for m in range((2 * len(x) * target + source) // (2 * source)):
        centre = m * source / target
        acc = total = 0.0
        for k in range(max(0, math.floor(centre) - math.ceil(width)), min(len(x), math.floor(centre) + math.ceil(width) + 2)):
            d = centre - k
            if abs(d) <= width:
                w = (1.0 if d == 0 else math.sin(math.pi * cut * d) / (math.pi * cut * d)) * (0.42 + 0.5 * math.cos(math.pi * d / width) + 0.08 * math.cos(2 * math.pi * d / width))
                acc, total = acc + x[k] * w, total + w
        out.append(acc / total if abs(total) > 1e-12 else 0.0)
    return out


@pytest.mark.parametrize("source,target,size,length", [(44100, 48000, 10, 205), (48000, 44100, 32, 200), (48000, 8000, 50, 333), (8000, 48000, 64, 64), (16000, 16000, 20, 61), (44100, 48000, 400, 1000)])
def test_resampling_equals_one_piece(spark, source, target, size, length):
    x = np.random.default_rng(length).normal(size=length).tolist()
    rows = [(s, b, x[b * size : (b + 1) * size]) for s in (1, 2) for b in range(-(-length // size))]
    df = spark.createDataFrame(rows, "s long, b long, x array<double>").repartition(3)
    made = S.resample(df, ["s"], "b", "x", size, source, target).select("s", "start", F.posexplode("value").alias("k", "v"))
    found = {(r.s, r.start + r.k): r.v for r in made.collect()}
    expected = plain_resample(x, source, target)
    assert sorted(found) == [(s, i) for s in (1, 2) for i in range(len(expected))]
    assert np.allclose([found[1, i] for i in range(len(expected))], expected, atol=1e-9)
    assert all(found[1, i] == pytest.approx(found[2, i], abs=1e-12) for i in range(len(expected)))


def test_resampling_gaps_nulls_and_level(spark):
    rows = [(1, b, [0.5] * 20) for b in range(9) if b != 4] + [(1, None, [9.0] * 20), (None, 0, [9.0] * 20), (2, 0, None)]
    df = spark.createDataFrame(rows, "s long, b long, x array<double>")
    made = {r.block: r for r in S.resample(df, ["s"], "b", "x", 20, 44100, 48000).collect()}
    assert sorted(made) == [0, 1, 2, 3, 5, 6, 7, 8]
    filled = [0.0 if i // 20 == 4 else 0.5 for i in range(180)]
    expected = plain_resample(filled, 44100, 48000)
    for r in made.values():
        assert np.allclose(r.value, expected[r.start : r.start + len(r.value)], atol=1e-9)
    assert expected[0] == pytest.approx(0.5)
    assert S.resample(df.where("false"), ["s"], "b", "x", 20, 44100, 48000).count() == 0


def plain_octaves(x, lag, longest, shortest, n, period, gain):
    head, least, size, period = longest // 2, shortest // 2, n // 2, period // 2
    dot = lambda k: float(np.dot(x[head : head + size], x[head - k : head - k + size])) if k >= 0 else 0.0
    power = lambda k: float(np.dot(x[head - k : head - k + size], x[head - k : head - k + size]))
    t0 = best = min(lag // 2, head - 1)
    level = lambda a, b: a / math.sqrt(1 + power(0) * b)
    xy, yy = dot(t0), power(t0)
    g0 = g = level(xy, yy)
    for k in range(2, 16):
        t = (2 * t0 + k) // (2 * k)
        if t < least:
            break
        other = (t0 if t + t0 > head else t + t0) if k == 2 else (2 * O.SECOND[k - 3] * t0 + k) // (2 * k)
        c, e = 0.5 * (dot(t) + dot(other)), 0.5 * (power(t) + power(other))
        near = abs(t - period)
        carried = gain if near <= 1 else 0.5 * gain if near <= 2 and 5 * k * k < t0 else 0.0
        if level(c, e) > (max(0.4, 0.85 * g0 - carried) if t < 3 * least else max(0.3, 0.7 * g0 - carried)):
            xy, yy, best, g = c, e, t, level(c, e)
    share = 1.0 if yy <= max(xy, 0) else max(xy, 0) / (yy + 1)
    a, b, c = (dot(best + d) for d in (-1, 0, 1))
    shift = 1 if c - a > 0.7 * (b - a) else -1 if a - c > 0.7 * (b - c) else 0
    return max(2 * best + shift, shortest), min(share, g)


def test_octave_errors_in_order(spark):
    rng = np.random.default_rng(3)
    rows = []
    for frame in range(12):
        period = 9 if frame < 6 else 14
        tone = np.sin(2 * np.pi * np.arange(96) / period) + 0.2 * np.sin(4 * np.pi * np.arange(96) / period) + 0.05 * rng.normal(size=96)
        rows += [(1, frame, tone.tolist(), 2 * period * (3 if frame % 3 else 2)), (2, frame, rng.normal(size=96).tolist(), int(rng.integers(10, 96)))]
    df = spark.createDataFrame([*rows, (3, 0, None, 20)], "s long, f long, x array<double>, lag int").repartition(4)
    made = O.corrected(df.select("s", "f", O.candidates(F.col("x"), F.col("lag"), 96, 8, 96).alias("c")), "s", "f", "c", 8)
    found = {(r.s, r.f): (r.lag, r.gain) for r in made.collect()}
    states = {1: (0, 0.0), 2: (0, 0.0)}
    for s, f, x, lag in sorted(rows, key=lambda r: (r[1], r[0])):
        states[s] = plain_octaves(np.array(x), lag, 96, 8, 96, *states[s])
        assert found[s, f][0] == states[s][0]
        assert found[s, f][1] == pytest.approx(states[s][1], abs=1e-9)
    assert abs(found[1, 0][0] - 18) <= 1 and found[1, 0][1] > 0.8
    assert found[3, 0] == (None, None)


def plain_boosts(channels, scale, size, capped):
    n, noise = 21, B.floor_levels(24)
    above = [max(c[i] - noise[i] for c in channels) for i in range(n)]
    deepest, mask = max(-31.9, *above), list(above)
    for i in range(1, n):
        mask[i] = max(mask[i], mask[i - 1] - 2)
    for i in reversed(range(n - 1)):
        mask[i] = max(mask[i], mask[i + 1] - 3)
    weight = [32 >> min(5, max(0, -math.floor(0.5 + above[i] - max(0, deepest - 12, mask[i])))) for i in range(n)]
    if size <= 50 or scale < 1:
        return deepest, 0, [0] * n, [13] * n, weight
    lows = []
    for x in channels:
        f, last = [x[0]], 0
        for i in range(1, n):
            last = i if x[i] > x[i - 1] + 0.5 else last
            f.append(min(f[-1] + 1.5, x[i]))
        for i in reversed(range(last)):
            f[i] = min(f[i], f[i + 1] + 2, x[i])
        for i in range(n):
            near = x[:3] if i < 2 else x[n - 3 :] if i >= n - 2 else x[i - 2 : i + 3]
            f[i] = max(f[i], sorted(near)[len(near) // 2] - 1, noise[i])
        lows.append(f)
    if len(channels) == 2:
        for i in range(n):
            lows[1][i] = max(lows[1][i], lows[0][i] - 4)
            lows[0][i] = max(lows[0][i], lows[1][i] - 4)
    e = [sum(max(0.0, c[i] - f[i]) for c, f in zip(channels, lows, strict=True)) / len(channels) for i in range(n)]
    told, total, out = [math.floor(0.5 + 13 * 2 ** min(v, 4)) for v in e], 0, [0] * n
    for i in range(n):
        v = min(4.0, e[i] * (0.5 if capped else 1) * (2 if i < 8 else 0.5 if i >= 12 else 1))
        w = len(channels) * (B.EDGES[i + 1] - B.EDGES[i]) << scale
        b = int(v) if w < 6 else int(v * 8) if w > 48 else int(v * w / 6)
        cost = b * w * 8 if w < 6 else b * w if w > 48 else b * 48
        if capped and (total + cost) >> 6 > 2 * size // 3:
            out[i], total = (2 * size // 3 << 6) - total, 2 * size // 3 << 6
            break
        out[i], total = b, total + cost
    return deepest, total, out, told, weight


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(-60, 60), min_size=21, max_size=21), min_size=2, max_size=2), st.sampled_from([(3, 160, False), (3, 52, True), (1, 60, True), (0, 160, False), (3, 50, False), (2, 200, True)]))
def test_boosts(spark, rows, how):
    scale, size, capped = how
    a, b = ([v / 8 + 1 / 64 for v in r] for r in rows)
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    for columns, channels in ((["a"], [a]), (["a", "b"], [a, b])):
        r = df.select(B.boosts([F.col(c) for c in columns], scale, size, capped=capped).alias("r")).first().r
        depth, *rest = plain_boosts(channels, scale, size, capped)
        assert r.depth == pytest.approx(depth, abs=1e-12)
        assert [r.total, r.boost, r.importance, r.weight] == rest


def test_a_peak_is_boosted(spark):
    x = [0.0] * 21
    x[15] = 10.0
    r = spark.createDataFrame([(x,)], "x array<double>").select(B.boosts([F.col("x")], 3, 200).alias("r")).first().r
    assert r.boost[15] > 0 and r.boost[3] == 0 and r.importance[15] > r.importance[3] == 13
