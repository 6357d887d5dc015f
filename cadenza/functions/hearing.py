"""Hearing models in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pcm import let, total

FLOOR = 1e-12


def bark(hz: Column) -> Column:
    """Zwicker's critical-band rate."""
    return 13.0 * F.atan(0.00076 * hz) + 3.5 * F.atan(F.pow(hz / 7500.0, F.lit(2.0)))


def bark_of(hz: float) -> float:
    return 13.0 * math.atan(0.00076 * hz) + 3.5 * math.atan((hz / 7500.0) ** 2)


def threshold_in_quiet(hz: Column) -> Column:
    """Terhardt's absolute threshold in dB, from 20 Hz up."""
    k = F.greatest(hz, F.lit(20.0)) / 1000.0
    return 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, F.lit(2.0))) + 0.001 * F.pow(k, F.lit(4.0))


def spreading_of(distance: float) -> float:
    """Schroeder's spreading function in dB over the distance in Bark of maskee from masker."""
    x = distance + 0.474
    return 15.81 + 7.5 * x - 17.5 * math.sqrt(1 + x * x)


def flatness_tonality(power: Column) -> Column:
    """Flatness in dB over -60, kept in 0 to 1: 1 for a tone, 0 for noise."""

    def of(safe: Column) -> Column:
        db = 10.0 * (total(safe, F.ln) / F.size(safe) / math.log(10.0) - F.log10(total(safe) / F.size(safe)))
        return F.greatest(F.least(db / -60.0, F.lit(1.0)), F.lit(0.0))

    return let(F.transform(power, lambda p: F.greatest(p, F.lit(FLOOR))), of)


def masking_offset(tonality: Column, tone_db: float = 18.0, noise_db: float = 6.0) -> Column:
    return tonality * tone_db + (1 - tonality) * noise_db


def masking_threshold(power: Column, spread: list[list[float]], tonality: Column) -> Column:
    """Power spread over all bins by a fixed matrix, lowered by the offset that tonality sets."""
    matrix = F.array(*(F.lit(row) for row in spread))
    gain = F.pow(F.lit(10.0), -masking_offset(tonality) / 10.0)
    return let(F.struct(power.alias("p"), gain.alias("g")), lambda s: F.transform(matrix, lambda row: total(F.zip_with(s["p"], row, lambda p, w: p * w)) * s["g"]))


def spread_matrix(bins: int, rate: float) -> list[list[float]]:
    """Row for each maskee, column for each masker, as power ratios."""
    z = [bark_of(k * rate / (2 * (bins - 1))) for k in range(bins)]
    return [[10 ** (spreading_of(z[i] - z[j]) / 10) for j in range(bins)] for i in range(bins)]


def perceptual_entropy(energy: Column, threshold: Column) -> Column:
    """Bits to code energies to within thresholds: sum of log2(2 round(sqrt(e / t)) + 1); pairs not positive are skipped."""
    bits = F.zip_with(energy, threshold, lambda e, t: F.when((e > 0) & (t > 0), F.log2(2 * F.round(F.sqrt(e / t)) + 1)).otherwise(0.0))
    return total(bits)
