"""Quantisers, gains and code lengths as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def power_quantise(x: Column, step: Column | float) -> Column:
    """sign(x) round(|x|^(3/4) / step)."""
    return (F.signum(x) * F.round(F.pow(F.abs(x), F.lit(0.75)) / step)).cast("long")


def scaled_quantise(x: Column, step: Column | float, scale_factor: Column, multiplier: float = 0.5) -> Column:
    """As power_quantise, after a gain of 2^(3/4 multiplier scale_factor)."""
    gain = F.pow(F.lit(2.0), 0.75 * multiplier * scale_factor)
    return (F.signum(x) * F.round(F.pow(F.abs(x), F.lit(0.75)) * gain / step)).cast("long")


def requantise(q: Column, gain: Column, scale_factor: Column | float = 0.0, multiplier: float = 0.5) -> Column:
    """sign(q) |q|^(4/3) 2^((gain - 210) / 4) 2^(-multiplier scale_factor)."""
    size = F.pow(F.abs(q).cast("double"), F.lit(4.0 / 3.0))
    return F.signum(q.cast("double")) * size * F.pow(F.lit(2.0), (gain - 210) / 4.0) * F.pow(F.lit(2.0), F.lit(-multiplier) * scale_factor)


def global_gain(step: Column, calibrated: bool = False) -> Column:
    """round(210 + 16/3 log2 step) in 0 to 255; calibrated: less 4 log2 9; 210 for a step that isn't positive."""
    shift = 4 * math.log2(9) if calibrated else 0.0
    gain = F.greatest(F.least(F.round(210 + 16.0 / 3.0 * F.log2(step) - shift), F.lit(255.0)), F.lit(0.0))
    return F.when(step > 0, gain).otherwise(210.0).cast("long")


def uniform_scale_factor(step: Column) -> Column:
    """round(100 + 16/3 log2 step + 64), null outside 0 to 255."""
    sf = F.round(164 + 16.0 / 3.0 * F.log2(step))
    return F.when((step > 0) & sf.between(0, 255), sf.cast("long"))


def escape_bits(magnitude: Column) -> Column:
    """Bits of the escape suffix: none under 16, else 2 floor(log2 m) - 3."""
    return F.when(magnitude >= 16, 2 * (F.length(F.bin(magnitude)) - 1) - 3).otherwise(0).cast("long")


def magnitude_class(top: Column) -> Column:
    """Table class by the largest magnitude; 16 stands for the escape tables."""
    steps = ((0, 0), (1, 1), (3, 5), (5, 7), (7, 10), (15, 13))  # fixed values of the format
    out = F.lit(16)
    for most, table in reversed(steps):
        out = F.when(top <= most, table).otherwise(out)
    return out.cast("long")


def band_class(top: Column) -> Column:
    """Class of a band by its largest magnitude: 0, at most 7, at most 12, at most 8191; null beyond."""
    return F.when(top == 0, 0).when(top <= 7, 7).when(top <= 12, 9).when(top <= 8191, 11).cast("long")


def section_header_bits(bands: Column) -> Column:
    return (4 + 5 * (F.floor(bands / 31) + 1)).cast("long")


def rice_bits(folded_shifted_sum: Column, n: Column, k: Column, order: Column, depth: int) -> Column:
    """Subframe header, warm-up samples, coding header and codes."""
    return (8 + order * depth + 10 + folded_shifted_sum + n * (1 + k)).cast("long")
