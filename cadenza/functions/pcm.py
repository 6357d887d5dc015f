"""Sample and array expressions.  Arrays hold DOUBLE samples unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum over an array, in order."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def count_where(values: Column, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, lambda x: keep(x)))


def max_abs(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))


def each(n: int, of: Callable[[Column], Column]) -> Column:
    """The array of of(0) ... of(n - 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def quantise(x: Column, bits: int) -> Column:
    """Clamped to [-1, 1] and rounded half away from zero; -1 goes to the lowest value."""
    top = float((1 << (bits - 1)) - 1)
    c = F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
    return F.when(c <= -1.0, F.lit(-top - 1)).otherwise(F.round(c * top)).cast("long")


def denormalise(q: Column, bits: int) -> Column:
    """Negatives by 2^(bits-1), others by 2^(bits-1) - 1."""
    top = float((1 << (bits - 1)) - 1)
    return F.when(q < 0, q / (top + 1)).otherwise(q / top)


def channel_block(samples: Column, channels: int, channel: int, start: int, frames: int) -> Column:
    """One channel of interleaved samples from a frame on, zero past the end."""
    if not 0 <= channel < channels:
        raise ValueError("no such channel")
    return each(frames, lambda i: F.coalesce(F.get(samples, (i + start) * channels + channel), F.lit(0.0)))


def signed_read(samples: Column, index: Column) -> Column:
    """The sample at an index, zero outside."""
    return F.coalesce(F.when(index >= 0, F.get(samples, index)), F.lit(0.0))


def difference(samples: Column, order: int) -> Column:
    """Residuals of the fixed predictors of order 1 to 4: repeated differences."""
    out = samples
    for _ in range(order):
        out = F.zip_with(F.slice(out, 2, F.size(out) - 1), F.slice(out, 1, F.size(out) - 1), lambda a, b: a - b)
    return out


def fold_sign(x: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.when(x < 0, -2 * x - 1).otherwise(2 * x)


def bit_length(x: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x))).cast("long")
