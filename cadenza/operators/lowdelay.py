"""Stereo decisions, pitch and comb filtering of the low-delay codec, as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import pcm
from .spectra import autocorrelation, levinson

#: Gains of the comb filter's three taps on either side, by tap set; fixed values of the format.
COMB = ((10048 / 32768, 7112 / 32768, 4248 / 32768), (15200 / 32768, 8784 / 32768, 0.0), (26208 / 32768, 3280 / 32768, 0.0))


def quarter_turn(y: Column, x: Column) -> Column:
    """The codec's rational approximation of atan2 for energies, which are not negative."""
    a, b, c = 0.43157974, 0.67848403, 0.08595542
    x2, y2 = x * x, y * y
    steep = math.pi / 2 - x * y * (y2 + a * x2) / ((y2 + b * x2) * (y2 + c * x2))
    flat = x * y * (x2 + a * y2) / ((x2 + b * y2) * (x2 + c * y2))
    return F.when(x2 + y2 < 1e-18, 0.0).when(x2 < y2, steep).otherwise(flat)


def split_angle(left: Column, right: Column) -> Column:
    """Angle of mid and side energies: 0 for all in mid, 16384 for all in side."""
    energy = lambda f: F.sqrt(1e-15 + pcm.total(F.zip_with(left, right, f), lambda v: v * v))
    return F.floor(0.5 + 16384 * 0.63662 * quarter_turn(energy(lambda a, b: a - b), energy(lambda a, b: a + b))).cast("long")


def merged(mid: Column, side: Column, gain: Column) -> Column:
    """Left and right from mid, with its gain, and side; a collapsed channel mirrors mid."""

    def of(s: Column) -> Column:
        left, right = s["g"] * s["g"] + s["e"] - 2 * s["x"], s["g"] * s["g"] + s["e"] + 2 * s["x"]
        whole = F.zip_with(mid, side, lambda m, d: F.struct(((s["g"] * m - d) / F.sqrt(left)).alias("l"), ((s["g"] * m + d) / F.sqrt(right)).alias("r")))
        return F.when((left < 6e-4) | (right < 6e-4), F.transform(mid, lambda m: F.struct(m.alias("l"), m.alias("r")))).otherwise(whole)

    return pcm.let(F.struct(gain.alias("g"), pcm.dot(side, side).alias("e"), (gain * pcm.dot(mid, side)).alias("x")), of)


def separate(left: Column, right: Column, coded: int, small: bool) -> Column:
    """Whether left and right cost less than mid and side; coded: lines of both channels, small: of the shorter frames."""
    size = lambda f: 1e-15 + pcm.total(F.zip_with(left, right, f))
    apart, joint = size(lambda a, b: F.abs(a) + F.abs(b)), size(lambda a, b: F.abs(a + b) + F.abs(a - b)) * math.sqrt(0.5)
    return (coded + (5 if small else 13)) * joint > coded * apart


def trim(left: Column, right: Column, logs: Sequence[Column], bands: Sequence[int], intensity: int, rate: int, transient: Column) -> Column:
    """Allocation trim, 0 to 10, and what stereo saves: by correlation of low bands, spectral tilt, rate and transience."""
    start = 4.0 if rate < 64000 else 4.0 + ((rate - 64000) >> 10) / 16 if rate < 80000 else 5.0
    products = F.array(*(pcm.dot(F.slice(left, a + 1, b - a), F.slice(right, a + 1, b - a)) for a, b in zip(bands, bands[1:], strict=False)))
    end = len(bands) - 1

    def of(p: Column) -> Column:
        low = F.least(F.lit(1.0), F.abs(pcm.total(F.slice(p, 1, 8)) / 8))
        least = F.least(F.lit(1.0), low, *(F.abs(F.get(p, k)) for k in range(8, intensity)))
        first = F.log2(1.001 - low * low)
        second = F.greatest(0.5 * first, F.log2(1.001 - least * least))
        tilt = sum((pcm.total(F.transform(log, lambda v, i: v * (2 + 2 * i - end) * F.when(i < end - 1, 1.0).otherwise(0.0))) for log in logs), F.lit(0.0)) / (len(logs) * (end - 1))
        value = start + F.greatest(F.lit(-4.0), 0.75 * first) - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (tilt + 1) / 6)) - 2 * transient
        return F.struct(F.greatest(F.least(F.floor(0.5 + value), F.lit(10)), F.lit(0)).cast("long").alias("trim"), F.least(F.lit(0.25), -0.5 * second).alias("saving"))

    return pcm.let(products, of)


def halved(samples: Column, n: int) -> Column:
    """Every other sample after a three-tap low-pass; zero before the first."""
    at = lambda k: pcm.signed_read(samples, k)
    return pcm.each(n // 2, lambda i: 0.5 * (0.5 * (at(2 * i - 1) + at(2 * i + 1)) + at(2 * i)))


def whitened(x: Column, n: int) -> Column:
    """Filtered by its own widened predictor of four taps, and a zero at 0.8."""
    lag = F.transform(autocorrelation(x, n, 5), lambda v, k: F.when(k == 0, v * 1.0001).otherwise(v * (1 - (0.008 * k) * (0.008 * k))))

    def of(s: Column) -> Column:
        taps = F.transform(levinson(s["r"], 4, 0.001), lambda a, k: -a * F.pow(F.lit(0.9), k + 1))
        five = pcm.let(taps, lambda t: F.array(F.get(t, 0) + 0.8, *(F.get(t, k) + 0.8 * F.get(t, k - 1) for k in (1, 2, 3)), 0.8 * F.get(t, 3)))
        return pcm.let(F.struct(s["x"].alias("x"), five.alias("f")), lambda v: pcm.each(n, lambda i: F.get(v["x"], i) + pcm.total(F.transform(v["f"], lambda c, k: c * pcm.signed_read(v["x"], i - 1 - k)))))

    return pcm.let(F.struct(lag.alias("r"), x.alias("x")), of)


def _best(correlations: Column, y: Column, n: int) -> Column:
    """The two lags of the highest positive correlation, squared over energy; 0 and 1 where none is positive."""
    scored = F.transform(correlations, lambda c, k: F.struct(F.when(c > 0, F.round(c * c / (1 + pcm.dot(F.slice(y, k + 1, F.lit(n)), F.slice(y, k + 1, F.lit(n)))), 9)).otherwise(-1.0).alias("s"), (-k).alias("k")))
    return F.transform(F.slice(F.sort_array(scored, asc=False), 1, 2), lambda s, j: F.when(s["s"] < 0, j).otherwise(-s["k"]))


def pitch(x: Column, y: Column, n: int, lags: int) -> Column:
    """Pitch lag of n samples of half rate in y: a coarse search at a quarter, a finer one about its two best, and half a step by the neighbours."""
    every = lambda a, size: pcm.each(size, lambda k: F.get(a, 2 * k))
    product = lambda a, b, size: lambda k: pcm.dot(a, F.slice(b, k + 1, F.lit(size)))

    def fine(s: Column) -> Column:
        coarse = _best(pcm.each(lags // 2, product(s["x4"], s["y4"], n // 2)), s["y4"], n // 2)

        def of(b: Column) -> Column:
            near = lambda i: (F.abs(i - 2 * F.get(b, 0)) <= 2) | (F.abs(i - 2 * F.get(b, 1)) <= 2)
            return pcm.each(lags, lambda i: F.when(near(i), F.greatest(product(s["x"], s["y"], n)(i), F.lit(-1.0))).otherwise(0.0))

        def end(c: Column) -> Column:
            best = F.get(_best(c, s["y"], n), 0)
            a, b, d = F.get(c, best - 1), F.get(c, best), F.get(c, best + 1)
            offset = F.when((best > 0) & (best < lags - 1), F.when(d - a > 0.7 * (b - a), 1).when(a - d > 0.7 * (b - d), -1).otherwise(0)).otherwise(0)
            return F.greatest(2 * best - offset, F.lit(0)).cast("long")

        return pcm.let(pcm.let(coarse, of), end)

    return pcm.let(F.struct(x.alias("x"), y.alias("y"), every(x, n // 2).alias("x4"), every(y, (n + lags) // 2).alias("y4")), fine)


def comb(samples: Column, n: int, before: tuple[int, float, int], after: tuple[int, float, int], window: Sequence[float]) -> Column:
    """Period, gain and tap set fade from one filter to the other over the window, squared; zero history."""
    fade = F.lit([float(w) for w in window])
    at = lambda k: pcm.signed_read(samples, k)

    def side(i: Column, filter_: tuple[int, float, int]) -> Column:
        t, gain, taps = max(filter_[0], 15), filter_[1], COMB[filter_[2]]
        return gain * (taps[0] * at(i - t) + taps[1] * (at(i - t + 1) + at(i - t - 1)) + taps[2] * (at(i - t + 2) + at(i - t - 2)))

    def one(i: Column) -> Column:
        share = pcm.let(F.coalesce(F.get(fade, i), F.lit(1.0)), lambda w: w * w) if before != after else F.lit(1.0)
        return at(i) + (1 - share) * side(i, before) + share * side(i, after)

    return pcm.each(n, one)
