"""Windows and transforms over short arrays, as products with constant bases.

A basis is a literal matrix of the plan, so a transform is a projection: it needs
no shuffle and no Python.  For long frames use ``operators.spectra``, which does
the same product for whole Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pcm import dot, let


def constants(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def sine_window(n: int) -> list[float]:
    return [math.sin(math.pi / n * (i + 0.5)) for i in range(n)]


def hann_window(n: int) -> list[float]:
    """Periodic."""
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]


def power_sine_window(n: int) -> list[float]:
    return [math.sin(math.pi / 2 * math.sin(math.pi / n * (i + 0.5)) ** 2) for i in range(n)]


def asymmetric_window(n: int, left: int, right: int) -> list[float]:
    """Power-sine slopes of left and right samples, centred on the quarters; zero before, one between, zero after."""
    rise, fall = power_sine_window(2 * left)[:left], power_sine_window(2 * right)[right:]
    a, b = n // 4 - left // 2, n * 3 // 4 - right // 2
    return [0.0] * a + rise + [1.0] * (b - a - left) + fall + [0.0] * (n - b - right)


def overlap_window(overlap: int) -> list[float]:
    """Rising half of the low-overlap window."""
    return [math.sin(math.pi / 2 * math.sin(math.pi / 2 * (i + 0.5) / overlap) ** 2) for i in range(overlap)]


def start_window(long: int = 36, short: int = 12) -> list[float]:
    """From a long block to short ones: long rise, flat, short fall, zeros."""
    rise, fall = sine_window(long)[: long // 2], sine_window(short)[short // 2 :]
    flat = (long // 2 - short // 2) // 2
    return rise + [1.0] * flat + fall + [0.0] * (long // 2 - flat - short // 2)


def stop_window(long: int = 36, short: int = 12) -> list[float]:
    return start_window(long, short)[::-1]


def blackman(x: float) -> float:
    """Over [-1, 1], zero outside."""
    return 0.42 + 0.5 * math.cos(math.pi * x) + 0.08 * math.cos(2 * math.pi * x) if abs(x) <= 1 else 0.0


def mdct_basis(lines: int, scale: float = 1.0) -> list[list[float]]:
    """cos(pi / N (n + 1/2 + N/2)(k + 1/2)): 2N samples to N lines."""
    return [[scale * math.cos(math.pi / lines * (n + 0.5 + lines / 2) * (k + 0.5)) for n in range(2 * lines)] for k in range(lines)]


def project(samples: Column, basis: list[list[float]]) -> Column:
    """The product of the basis with the samples."""
    return let(samples, lambda x: F.transform(F.array(*(constants(row) for row in basis)), lambda row: dot(x, row)))


def windowed(samples: Column, window: Sequence[float]) -> Column:
    return F.zip_with(samples, constants(window), lambda x, w: x * w)


def mdct(samples: Column, lines: int, window: Sequence[float] | None = None, scale: float = 1.0) -> Column:
    return project(samples, _with(mdct_basis(lines, scale), window))


def imdct(lines: Column, n: int, scale: float = 1.0) -> Column:
    """Before overlap and addition, which cancel its aliases."""
    basis = mdct_basis(n, scale)
    return project(lines, [[basis[k][i] for k in range(n)] for i in range(2 * n)])


def power_spectrum(samples: Column, n: int, window: Sequence[float] | None = None) -> Column:
    """Squared magnitudes of bins 0 to n / 2 of the DFT."""
    bins = range(n // 2 + 1)
    re = _with([[math.cos(2 * math.pi * k * i / n) for i in range(n)] for k in bins], window)
    im = _with([[-math.sin(2 * math.pi * k * i / n) for i in range(n)] for k in bins], window)
    return let(samples, lambda x: F.zip_with(project(x, re), project(x, im), lambda a, b: a * a + b * b))


def _with(basis: list[list[float]], window: Sequence[float] | None) -> list[list[float]]:
    return basis if window is None else [[b * w for b, w in zip(row, window, strict=True)] for row in basis]


def haar(values: Column) -> Column:
    """Butterflies of neighbouring pairs: sums and differences over the square root of 2."""
    half = math.sqrt(0.5)
    pairs = F.transform(F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1), lambda i: F.array((F.get(values, 2 * i) + F.get(values, 2 * i + 1)) * half, (F.get(values, 2 * i) - F.get(values, 2 * i + 1)) * half))
    return F.flatten(pairs)
