"""Coarse energies: steps decode to the energies carried on, places of steps, rows don't depend on their batch, edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import coarse as C

SHAPES = C.ruled_shapes(16)


def through(x, octets, mode, forced=False):
    """One stream, frame by frame."""
    state, out = np.zeros((1, mode.bands * mode.channels + 1)), []
    for e, size in zip(np.asarray(x, float), np.broadcast_to(octets, len(x)), strict=True):
        state, made = C.frames(state, e[None], np.array([size]), np.array([forced]), mode)
        out.append({k: v[0] for k, v in made.items()})
    return out


def decoded(steps, alone, old, mode):
    """What a decoder makes of one frame's steps."""
    kept, leak = (0.0, C.LEAK_ALONE) if alone else (C.KEPT[mode.scale], C.LEAK[mode.scale])
    now = []
    for c in range(mode.channels):
        below = 0.0
        for b in range(mode.bands):
            q = steps[c * mode.bands + b]
            now.append(kept * max(old[c * mode.bands + b], -9.0) + below + q)
            below += q - leak * q
    return now


signals = st.lists(st.lists(st.floats(-30, 20), min_size=32, max_size=32), min_size=1, max_size=4)


@settings(max_examples=100, deadline=None)
@given(signals, st.integers(0, 60), st.integers(1, 2), st.integers(0, 3), st.booleans(), st.booleans())
def test_steps_decode_to_what_is_carried_on(rows, octets, channels, scale, both, bass):
    mode = C.Energies(SHAPES, channels, scale, both, 10, bass)
    x = [r[: 16 * channels] for r in rows]
    old = [0.0] * 16 * channels
    for made, e in zip(through(x, octets, mode), x, strict=True):
        now = decoded(made["steps"], made["alone"], old, mode)
        assert made["energies"] == pytest.approx(now)
        assert made["energies"] + made["left"] == pytest.approx(e)
        assert made["eighths"] <= max(8 * 8 * octets, 8)
        old = now


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 2), st.integers(0, 3), st.booleans(), st.booleans())
def test_many_frames_at_once_are_as_one_by_one(seed, channels, scale, both, bass):
    rng, mode, n = np.random.default_rng(seed), C.Energies(SHAPES, channels, scale, both, 25, bass), C.FEW + 8
    states = np.column_stack([rng.normal(0, 6, (n, 16 * channels)), rng.uniform(0, 200, n)])
    x, octets, forced = rng.normal(0, rng.choice([2, 6, 25]), (n, 16 * channels)), rng.integers(0, rng.choice([6, 30, 90]), n), rng.random(n) < 0.2
    after, made = C.frames(states, x, octets, forced, mode)
    for k in range(n):
        own_after, own = C.frames(states[k : k + 1], x[k : k + 1], octets[k : k + 1], forced[k : k + 1], mode)
        assert (own_after[0] == after[k]).all() and all((own[c][0] == made[c][k]).all() for c in made)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 255), st.integers(0, 179))
def test_places_of_steps_are_disjoint(zero, decay):
    starts, sizes, least, most = C.laplace(zero << 7, decay << 6)
    assert starts[0] == zero << 7 and (np.diff(starts) == 2 * sizes[:-1]).all() and (sizes >= 1).all()
    assert -least - most in (0, 1) and starts[-1] + sizes[-1] * (1 + (most == -least)) <= 1 << 15
    assert most >= 15


def test_a_frame_by_hand():
    mode = C.Energies(SHAPES[:, :2])
    # alone: 3 of 3.2 in the first band, then 1 less three quarters of it; both ways are equal from silence but for the leak
    made = through([[3.2, 1.0]], 100, mode, forced=True)[0]
    assert made["alone"] and made["steps"].tolist() == [3, -2]
    assert made["energies"] == pytest.approx([3.0, 3 * (1 - 4915 / 32768) - 2])
    # 3 bits less one eighth of the flag, then what the two steps cost by their shares
    shares = [1 / 8]
    for band, q in ((0, 3), (1, -2)):
        _, sizes, *_ = C.laplace(int(SHAPES[1, band, 0]) << 7, int(SHAPES[1, band, 1]) << 6)
        shares.append(sizes[abs(q) - 1] / 32768)
    assert made["eighths"] == pytest.approx(8 + -8 * sum(map(math.log2, shares)), abs=1.5)


def test_a_steady_stream_is_predicted_and_a_jump_stands_alone():
    mode = C.Energies(SHAPES, both=False)
    steady, jump = [5.0] * 16, [-7.0, 9.0] * 8
    made = through([steady, steady, steady, jump, jump], 80, mode)
    assert [bool(m["alone"]) for m in made] == [False, True, False, False, True]
    assert [bool(m["alone"]) for m in through([steady] * 8, 80, C.Energies(SHAPES))][2:] == [False] * 6
    assert all(m["alone"] for m in through([steady] * 3, 80, C.Energies(SHAPES), forced=True))


def test_without_room_every_step_is_down():
    made = through([[3.0] * 16], 0, C.Energies(SHAPES))[0]
    assert made["steps"].tolist() == [-1] * 16 and not made["alone"] and made["eighths"] == 8
    # energies fall no faster than an eighth of an octave for each byte, were there room
    far = through([[0.0] * 16, [-60.0] * 16], 40, C.Energies(SHAPES))
    assert far[1]["energies"][0] >= -16


def test_shapes_are_checked():
    with pytest.raises(ValueError):
        C.Energies(np.zeros((2, 16, 2), int))
    with pytest.raises(ValueError):
        C.Energies(np.full((2, 16, 2), 200))


def test_batches_nulls_and_streams(spark):
    rng = np.random.default_rng(5)
    mode, rows, per = C.Energies(SHAPES, 2, 1, loss=30), [], {None: 7, "a": 40, "b": 1, "c": 12}
    for key, n in per.items():
        for k in range(n):
            rows.append((key, k, rng.normal(0, 4, 32).tolist(), int(rng.integers(0, 90)), bool(rng.random() < 0.1)))
    broken = [("a", 1000, None, 5, None), ("a", 20.5, [1.0] * 31, 5, None), ("a", 21.5, [float("nan")] * 32, 5, None), ("c", -1.0, [1.0] * 31 + [None], 5, None), ("c", 4.5, [1.0] * 32, None, None), ("c", 5.5, [1.0] * 32, -1, None)]
    schema = "s string, k double, x array<double>, size long, force boolean"
    df = spark.createDataFrame([(s, float(k), *r) for s, k, *r in rows + broken], schema)

    def result(batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            return {(r.s, r.k): r for r in C.coarse(df, "s", "k", "x", "size", mode, "force").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    whole = result(10000)
    assert result(3) == whole == result(1) and len(whole) == len(rows) + len(broken)
    assert all(whole[s, float(k)][2:] == (None,) * 5 for s, k, *_ in broken)
    for key, n in per.items():
        own = [r for r in rows if r[0] == key]
        state = np.zeros((1, 33))
        for r in own:
            state, made = C.frames(state, np.array([r[2]]), np.array([r[3]]), np.array([r[4]]), mode)
            got = whole[key, float(r[1])]
            assert (got.alone, got.eighths, got.steps) == (made["alone"][0], made["eighths"][0], made["steps"][0].tolist())
            assert got.energies == made["energies"][0].tolist() and got.left == made["left"][0].tolist()
    assert {r.alone for r in whole.values()} == {True, False, None}
    empty = C.coarse(df.limit(0), "s", "k", "x", "size", mode)
    assert empty.count() == 0 and empty.columns == ["s", "k", "alone", "eighths", "steps", "left", "energies"]
