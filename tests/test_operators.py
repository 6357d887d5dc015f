"""Goldens and invariants of operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import codes, pcm, transforms
from cadenza.operators import blocks, codebooks, compare, rate, spectra


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(values):
    return F.lit([float(v) for v in values])


def test_channel_block(spark):
    x = arr([1, -1, 2, -2, 3, -3])
    assert one(spark, pcm.channel_block(x, 2, 0, 0, 4)) == [1, 2, 3, 0]
    assert one(spark, pcm.channel_block(x, 2, 1, 1, 3)) == [-2, -3, 0]
    assert one(spark, pcm.channel_block(x, 2, 0, 4, 2)) == [0, 0]
    with pytest.raises(ValueError):
        pcm.channel_block(x, 2, 2, 0, 1)


def test_compare(spark):
    d = compare.array_difference(arr([0, 0.5]), arr([0, 0.25]))
    assert one(spark, d)["max_abs"] == 0.25
    silent = compare.array_difference(arr([0, 0]), arr([0, 0]))
    assert one(spark, silent)["snr_db"] is None
    assert one(spark, compare.array_difference(arr([1, 0]), arr([1, 0])))["snr_db"] == math.inf
    near = compare.array_difference(arr([0, 0.25, -0.25]), arr([0, 0.251, -0.249]))
    assert one(spark, compare.verdict(near, compare.Tolerance(0.002, 0.001, 45))) == "pass"
    assert one(spark, compare.verdict(near, compare.Tolerance(0.0001, 1, 0))) == "max_abs"
    assert one(spark, compare.verdict(near, compare.Tolerance(1, 0.0001, 0))) == "rms"
    assert one(spark, compare.verdict(near, compare.Tolerance(1, 1, 80))) == "snr_db"
    assert one(spark, compare.verdict(silent, compare.Tolerance(snr_db=0))) == "snr_db"
    with pytest.raises(ValueError):
        compare.Tolerance(max_abs=float("nan"))


def test_windows():
    assert transforms.sine_window(4) == pytest.approx([0.38268343, 0.9238795, 0.9238795, 0.38268343])
    assert transforms.stop_window() == transforms.start_window()[::-1] and len(transforms.start_window()) == 36
    w = transforms.power_sine_window(16)
    assert [w[i] ** 2 + w[i + 8] ** 2 for i in range(8)] == pytest.approx([1] * 8)
    assert transforms.asymmetric_window(16, 8, 8) == pytest.approx(w)


def test_mdct(spark):
    assert one(spark, transforms.mdct(arr([1, 0, 0, 0]), 2)) == pytest.approx([0.38268343, -0.9238795])
    assert one(spark, transforms.mdct(arr([0] * 8), 4)) == [0] * 4
    long = np.random.default_rng(0).normal(size=(3, 128))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(long)] + [(9, [1.0]), (10, None)], "i int, x array<double>")
    found = {r["i"]: r["y"] for r in spectra.transform(df, "x", spectra.mdct_matrix(64), "y").collect()}
    assert found[9] is None and found[10] is None
    assert found[1] == pytest.approx((long[1] @ spectra.mdct_matrix(64)).tolist())


def test_quantiser(spark):
    values = [-16, -1, 0, 1, 16]
    assert one(spark, F.transform(arr(values), lambda x: codes.power_quantise(x, 1.0))) == [-8, -1, 0, 1, 8]
    assert one(spark, F.transform(arr(values), lambda x: codes.power_quantise(x, 2.0))) == [-4, -1, 0, 1, 4]


def schedule(flags):
    """Long, start, short and stop, by their definition."""
    short = [t or (0 < i < len(flags) - 1 and flags[i - 1] and flags[i + 1]) for i, t in enumerate(flags)]
    return "".join("S" if s else "a" if i + 1 < len(short) and short[i + 1] else "z" if i and short[i - 1] else "L" for i, s in enumerate(short))


def test_block_schedule(spark):
    cases = ["".join(c) for n in (1, 2, 5, 6) for c in itertools.product("TF", repeat=n)]
    rows = [(k, i, c == "T") for k, case in enumerate(cases) for i, c in enumerate(case)]
    out = blocks.block_schedule(spark.createDataFrame(rows, "k int, i int, t boolean"), "k", "i", "t").collect()
    letters = {"long": "L", "start": "a", "short": "S", "stop": "z"}
    found = {}
    for r in sorted(out, key=lambda r: (r["k"], r["i"])):
        found[r["k"]] = found.get(r["k"], "") + letters[r["block_type"]]
    assert [found[k] for k in range(len(cases))] == [schedule([c == "T" for c in case]) for case in cases]
    by = dict(zip(cases, (found[k] for k in range(len(cases))), strict=True))
    assert (by["FFTFF"], by["FTFTF"], by["FTFFTF"], by["TF"], by["FT"]) == ("LaSzL", "aSSSz", "aSzaSz", "Sz", "aS")


@pytest.mark.parametrize(("weights", "total", "floor", "bits"), [([3, 1], 800, 100, [550, 250]), ([1, 1, 1], 1001, 0, [334, 334, 333]), ([0, 0, 0, 0], 1000, 100, [250] * 4), ([5, 1], 150, 100, [75, 75])])
def test_allocation(spark, weights, total, floor, bits):
    df = spark.createDataFrame([(1, i, float(w)) for i, w in enumerate(weights)], "k int, i int, w double")
    assert [r["bits"] for r in rate.allocate(df, ["k"], "i", "w", total, floor).orderBy("i").collect()] == bits


def test_padding_closed_form(spark):
    remainder, rest, loop = 128 * 144000 % 44100, 0, []
    for _ in range(300):
        rest += remainder
        loop.append(rest // 44100)
        rest %= 44100
    assert [r["p"] for r in spark.range(300).select(rate.padded(F.col("id"), remainder, 44100).alias("p")).collect()] == loop


def test_step_selection(spark):
    df = spark.createDataFrame([(1, 0.5, 100), (1, 0.25, 90), (1, 0.25, 95), (2, 0.1, 300), (2, 0.2, 250)], "k int, s double, n int")
    assert {r["k"]: (r["s"], r["n"]) for r in rate.finest_step(df, ["k"], "s", "n").collect()} == {1: (0.25, 95), 2: (0.1, 300)}
    assert {r["k"]: (r["s"], r["n"], r["fits"]) for r in rate.within_budget(df, ["k"], "s", "n", F.lit(92)).collect()} == {1: (0.25, 90, True), 2: (0.2, 250, False)}


def test_spectral_regions(spark):
    found = one(spark, codebooks.spectral_regions(F.lit([3, 1, 0, 1, 1, 0, 0, 0])))
    assert found.asDict() == {"big_pairs": 1, "count1_quads": 1, "zero_lines": 3}
    assert one(spark, codebooks.spectral_regions(F.lit([0, 0, 0, 0]))).asDict() == {"big_pairs": 0, "count1_quads": 0, "zero_lines": 4}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40).filter(lambda c: sum(n > 0 for n in c) > 1))
def test_huffman(counts):
    lengths = codebooks.huffman_lengths(counts)
    assert sum(2.0**-n for n in lengths if n) == pytest.approx(1)
    words = [format(c, f"0{n}b") for c, n in zip(codebooks.codewords(lengths), lengths, strict=True) if n]
    assert all(not b.startswith(a) for a, b in itertools.permutations(words, 2))
    total = sum(counts)
    entropy = -sum(n * math.log2(n / total) for n in counts if n)
    assert entropy - 1e-9 <= sum(n * m for n, m in zip(lengths, counts, strict=True)) < entropy + total


def test_packed_bits(spark):
    bits = codebooks.pack_codes(F.lit([5, 1]), F.lit([3, 6]))
    assert one(spark, bits) == "101000001"
    assert one(spark, codebooks.packed(bits)) == bytearray([0b10100000, 0b10000000])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=2, max_size=5))
def test_pulse_vectors(y):
    k = sum(abs(v) for v in y)
    index = codebooks.pulse_index(y)
    assert 0 <= index < codebooks.pulse_codewords(len(y), k)
    assert codebooks.pulse_from_index(index, len(y), k) == y


def test_pulse_search():
    y = codebooks.pulse_vector(np.array([0.9, -0.1, 0.4]), 6)
    assert np.abs(y).sum() == 6 and y[0] > y[2] > 0
    assert codebooks.pulse_codewords(3, 2) == 18


def test_side_fraction(spark):
    assert one(spark, blocks.side_fraction(arr([0, 0]), arr([0, 0]))) == 0
    assert one(spark, blocks.side_fraction(arr([1, 2]), arr([1, 2]))) == 0
    assert one(spark, blocks.side_fraction(arr([1]), arr([-1]))) == 1


def test_ordered_fold_carries_state_over_batches(spark):
    from cadenza.operators.fold import ordered_fold

    rows = [(k, i, 1) for k in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = ordered_fold(df, "k", "i", 0, lambda t, k, i, n: (t + n, (k, i, t + n)), "k string, i long, t long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 150 and all(r["t"] == r["i"] + 1 for r in found)
    assert ordered_fold(df.limit(0), "k", "i", 0, lambda t, k, i, n: (t, (k, i, t)), "k string, i long, t long").count() == 0


def test_filterbank_matrices():
    import numpy as np

    from cadenza.operators import filterbank as B

    a = B.alias_matrix()
    assert np.allclose(a @ a.T, np.eye(576))  # rotations
    assert sorted(B.short_order().tolist()) == list(range(576))
    long, short = (B.granule_matrix(B.low_pass(), s) for s in (False, True))
    assert long.shape == short.shape == (B.BEFORE + B.GRANULE, B.GRANULE)
    tone = np.sin(np.pi / 32 * 10.5 * (np.arange(B.BEFORE + B.GRANULE) + 0.5))  # in the middle of subband 10
    energy = (tone @ long) ** 2
    assert energy[9 * 18 : 12 * 18].sum() > 0.98 * energy.sum()


def test_variable_rate_drift_settles(spark):
    from cadenza.operators import rate

    frames = spark.createDataFrame([("s", i, 12_000 + 1_600 * (i % 2), 100, 24) for i in range(1_100)], "k string, i long, t long, s long, b long")
    rows = rate.variable_rate_drift(frames, "k", "i", "t", "s", "b", nominal=12_800, ceiling=1275, lm=2).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1_100)) and all(2 <= r["bytes"] <= 637 and r["reservoir"] >= 0 for r in rows)


def test_flac_alone_waits_for_more():
    from cadenza.sources.errors import AudioError
    from cadenza.streaming.decoder import flac, push

    assert push(b"", b"fL", flac) == (b"fL", "waiting", {})
    assert push(b"fL", b"aC", flac)[1] == "waiting"
    assert push(b"", b"OggS", flac) == (b"", "UnsupportedFormat", {})
    assert issubclass(AudioError, Exception)
