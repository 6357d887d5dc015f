"""Bit allocation: every eighth is accounted for, rows don't depend on their batch, edges of budgets."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import allocation as A

MODES = [A.Mode(A.ruled_rows(), A.ruled_caps(), c, scale) for c in (1, 2) for scale in (0, 1, 3)]


def run(mode, total, trim=5, offsets=None, intensity=21, dual=0, before=0):
    full = lambda v: np.atleast_1d(np.asarray(v, np.int64))
    total = full(total)
    spread = lambda v: np.broadcast_to(full(v), total.shape).copy()
    offsets = np.zeros((len(total), 21), np.int64) if offsets is None else np.asarray(offsets, np.int64)
    return A.allocate(total, spread(trim), offsets, spread(intensity), spread(dual), spread(before), mode)


frames = st.lists(st.tuples(st.integers(0, 20000), st.integers(0, 10), st.lists(st.sampled_from([0, 0, 0, 48, 96]), min_size=21, max_size=21), st.integers(0, 21), st.integers(0, 1), st.integers(0, 21)), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(MODES), frames)
def test_every_eighth_is_accounted_for(mode, rows):
    total, trim, offsets, intensity, dual, before = map(list, zip(*rows, strict=True))
    # boosts never take more than half of a budget
    offsets = [[o if sum(os) * 2 <= t else 0 for o in os] for os, t in zip(offsets, total, strict=True)]
    total = [max(t, 400) for t in total]
    made = run(mode, total, trim, offsets, intensity, dual, before)
    used = made["pulses"].sum(1) + (mode.channels << 3) * made["fine"].sum(1) + made["side"] + made["balance"]
    assert used.tolist() == total
    assert (made["pulses"] >= 0).all() and (made["fine"] >= 0).all() and (made["fine"] <= 8).all() and (made["balance"] >= 0).all()
    assert ((made["coded"] >= 1) & (made["coded"] <= 21)).all() and (made["intensity"] <= made["coded"]).all()
    assert all((p[c:] == 0).all() for p, c in zip(made["pulses"], made["coded"], strict=True))
    assert (made["pulses"] <= np.maximum(mode.cap, mode.channels << 3)).all()
    for i, row in enumerate(rows):
        alone = run(mode, total[i], trim[i], [offsets[i]], row[3], row[4], row[5])
        assert all((alone[k][0] == made[k][i]).all() for k in made)


def test_more_budget_codes_more_bands():
    made = run(MODES[5], np.arange(0, 16000, 200))
    assert (np.diff(made["coded"]) >= 0).all() and made["coded"][-1] == 21
    assert (np.diff(made["pulses"].sum(1) + 16 * made["fine"].sum(1)) >= 0).all()


def test_nothing_to_give():
    for mode in MODES:
        made = run(mode, [0, -5, 7])
        assert (made["pulses"][:2] == 0).all() and (made["fine"] == 0).all()
        assert made["pulses"][2].sum() == 7


def test_a_budget_beyond_all_caps_is_left_over():
    mode = MODES[2]
    made = run(mode, [mode.cap.sum() * 4])
    assert made["balance"][0] > 0 and made["coded"][0] == 21 and (made["fine"][0] == 8).all()


def test_trim_tilts_towards_low_bands():
    made = run(MODES[2], [4000, 4000], trim=[2, 8])
    low = (made["pulses"] + 8 * made["fine"])[:, :8].sum(1)
    assert low[1] > low[0]


def test_boosted_bands_are_kept():
    offsets = np.zeros((1, 21), np.int64)
    offsets[0, 18] = 400
    assert run(MODES[2], [1500], offsets=offsets)["coded"][0] >= 19 > run(MODES[2], [1500])["coded"][0]


def test_largest_step():
    limits = np.array([0, 1, 5, 63, 200])
    assert A.largest(lambda k: k <= limits, 63, 5).tolist() == [0, 1, 5, 63, 63]
    assert A.largest(lambda k: k <= limits, 10, 5).tolist() == [0, 1, 5, 10, 10]


def test_rows_of_tables(spark):
    zero = [0] * 21
    rows = [(1, 3000, 5, zero, 10, 0, 0), (2, None, 5, zero, 10, 0, 0), (3, 3000, 5, None, 10, 0, 0), (4, 3000, 5, [0] * 20, 10, 0, 0), (5, 3000, 5, zero, 10, 1, 21)]
    df = spark.createDataFrame(rows, "id long, total long, trim int, o array<int>, i int, d int, b int")
    out = {r.id: r.a for r in A.allocations(df, ["total", "trim", "o", "i", "d", "b"], "a", MODES[5]).collect()}
    assert out[2] is out[3] is out[4] is None
    expected = run(MODES[5], [3000, 3000], intensity=[10, 10], dual=[0, 1], before=[0, 21])
    for k, i in ((1, 0), (5, 1)):
        assert out[k].pulses == expected["pulses"][i].tolist() and out[k].coded == expected["coded"][i] and out[k].balance == expected["balance"][i]
    assert A.allocations(df.where("false"), ["total", "trim", "o", "i", "d", "b"], "a", MODES[5]).count() == 0


@pytest.mark.parametrize("mode", MODES)
def test_rows_rise(mode):
    assert (np.diff(np.asarray(mode.rows), axis=0) >= 0).all()
