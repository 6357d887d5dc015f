"""Noise budgets of bands, and the scale factors that keep quantisation within them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import pcm

#: Noise that any band may hold.
LEAST = 1e-12
#: Largest magnitude that the coder can write; a fixed value of the format.
BOUND = 8191


def bins_of(bands: Sequence[tuple[int, int]], line_hz: float, bin_hz: float, bins: int) -> list[list[int]]:
    """The spectrum's bins within each band of lines; where there is none, the bin nearest to its centre."""
    out = []
    for lo, hi in bands:
        held = [k for k in range(bins) if lo * line_hz <= k * bin_hz < hi * line_hz]
        out.append(held or [min(int((lo + hi) / 2 * line_hz / bin_hz + 0.5), bins - 1)])
    return out


def allowed(lines: Column, power: Column, threshold: Column, bands: Sequence[tuple[int, int]], bins: Sequence[Sequence[int]]) -> Column:
    """By band: its energy by the ratio of masked to own power; infinite where the bins hold no power but the lines do."""

    def one(lo: int, hi: int, held: Sequence[int]) -> Column:
        energy = pcm.total(F.slice(lines, lo + 1, hi - lo), lambda x: x * x)
        own, masked = (pcm.total(F.slice(a, held[0] + 1, len(held))) for a in (power, threshold))
        return F.when(energy <= 0, LEAST).when(own > 0, F.greatest(masked / own * energy, F.lit(LEAST))).otherwise(float("inf"))

    return F.array(*(one(lo, hi, held) for (lo, hi), held in zip(bands, bins, strict=True)))


def quantised(x: Column, step: float, scale_factor: Column) -> Column:
    """Magnitude of a line after a gain of 2^(3/8 scale_factor)."""
    return F.round(F.pow(F.abs(x), F.lit(0.75)) / step * F.pow(F.lit(2.0), 0.375 * scale_factor))


def noise(lines: Column, step: float, gain: float, scale_factor: Column) -> Column:
    """Energy of what is lost by quantising and restoring the lines."""
    back = lambda x: F.pow(quantised(x, step, scale_factor), F.lit(4 / 3)) * gain * F.pow(F.lit(2.0), -0.5 * scale_factor)
    return pcm.total(lines, lambda x: (F.abs(x) - back(x)) * (F.abs(x) - back(x)))


def scale_factors(lines: Column, budget: Column, bands: Sequence[tuple[int, int]], caps: Sequence[int], step: float, gain: float) -> Column:
    """The factors at which a loop ends that raises every band over its budget by one at a time.

    Bands don't act on each other, so a band stops at its first factor within the
    budget, or at its cap; the loop ends early, with the pass before, when a line
    grows over BOUND.
    """

    def first(k: int, lo: int, hi: int) -> Column:
        band = F.slice(lines, lo + 1, hi - lo)
        over = F.transform(F.sequence(F.lit(0), F.lit(caps[k] - 1)), lambda s: noise(band, step, gain, s) > F.get(budget, k))
        return F.coalesce(F.nullif(F.array_position(over, False), F.lit(0)) - 1, F.lit(caps[k])).cast("long")

    def clipped(ends: Column) -> Column:
        tops = F.array(*(pcm.max_abs(F.slice(lines, lo + 1, hi - lo)) for lo, hi in bands))
        over = F.transform(F.sequence(F.lit(0), F.lit(max(caps))), lambda p: F.exists(F.zip_with(tops, ends, lambda t, e: quantised(t, step, F.least(e, p)) > BOUND), lambda x: x))
        last = F.greatest(F.coalesce(F.nullif(F.array_position(over, True), F.lit(0)) - 2, F.lit(max(caps))), F.lit(0))
        return F.transform(ends, lambda e: F.least(e, last.cast("long")))

    return pcm.let(F.array(*(first(k, lo, hi) for k, (lo, hi) in enumerate(bands))), clipped)


def distortion(noises: Column, budget: Column) -> Column:
    """Sum of noise over budget, over the bands whose budget is finite."""
    return pcm.total(F.zip_with(noises, budget, lambda n, b: F.when(b < float("inf"), n / F.greatest(b, F.lit(LEAST))).otherwise(0.0)))


def weighted_power(power: Column, tonality: Column, tone_db: float = 18.0, noise_db: float = 6.0) -> Column:
    """Each masker's power less what its own tonality takes off."""
    return F.zip_with(power, tonality, lambda p, t: p * F.pow(F.lit(10.0), -(t * tone_db + (1 - t) * noise_db) / 10))


def windowed_tonality(power: Column, bins: int, reach: int = 8) -> Column:
    """Flatness over the bins within reach of each, by running sums; 1 for a tone, 0 for noise."""
    import math

    safe = F.transform(power, lambda p: F.greatest(p, F.lit(1e-12)))

    def running(values: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0.0)).alias("a"))
        return F.aggregate(values, start, lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["a"], F.array(t["s"] + x)).alias("a")), lambda t: t["a"])

    def of(sums: Column) -> Column:
        def one(k: Column) -> Column:
            lo, hi = F.greatest(k - reach, F.lit(0)), F.least(k + reach + 1, F.lit(bins))
            mean = lambda c: (F.get(sums[c], hi) - F.get(sums[c], lo)) / (hi - lo)
            db = 10.0 * (mean("l") / math.log(10.0) - F.log10(mean("p")))
            return F.greatest(F.least(db / -60.0, F.lit(1.0)), F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)

    return pcm.let(F.struct(running(F.transform(safe, lambda p: F.ln(p))).alias("l"), running(safe).alias("p")), of)
