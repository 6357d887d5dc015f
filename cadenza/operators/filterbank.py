"""The hybrid filterbank as matrices: a granule's lines are one product with its samples.

Polyphase subbands, inversion, transform and alias reduction are all linear, so
they are composed once into a matrix, and ``operators.spectra.transform``
multiplies each Arrow batch of granules by it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..functions import transforms as T
from .spectra import mdct_matrix

BANDS, TAPS, HOPS = 32, 512, 18
GRANULE = BANDS * HOPS
#: Samples before a granule that its lines depend on: the granule before, and what the first hop there looks back at.
BEFORE = GRANULE + TAPS - BANDS

#: Coefficients from which the alias butterflies are made; fixed values of the format.
ALIAS = (-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037)
#: First lines of the long and short scale-factor bands at 44.1 kHz; fixed values of the format.
LONG_BANDS = (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418)
SHORT_BANDS = (0, 4, 8, 12, 16, 22, 30, 40, 52, 66, 84, 106, 136, 192)


def low_pass(taps: int = TAPS, bands: int = BANDS) -> np.ndarray:
    """A windowed sinc of half a band's width, signed as the polyphase sum wants it; callers may bring another."""
    n = np.arange(taps)
    h = np.sinc((n - taps / 2) / (2 * bands)) / (2 * bands) * np.asarray(T.hann_window(taps))
    return np.where(n // (2 * bands) % 2 == 1, -h, h)


def polyphase_matrix(window: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Samples, oldest first, to the subbands of one hop."""
    n = np.arange(len(window))
    basis = window[:, None] * np.cos(np.outer(n % (2 * bands) - bands / 2, 2 * np.arange(bands) + 1) * np.pi / (2 * bands))
    return basis[::-1]


def cosine_matrix(bands: int = BANDS) -> np.ndarray:
    """One slot of samples to cosine-modulated subbands."""
    half = np.arange(bands) + 0.5
    return -0.25 * np.cos(np.pi / bands * np.outer(half, half))


def short_matrix() -> np.ndarray:
    """36 subband samples to three windows of six lines, at hops of six."""
    one = mdct_matrix(6, T.sine_window(12))
    out = np.zeros((36, 18))
    for w in range(3):
        out[6 + 6 * w : 18 + 6 * w, 6 * w : 6 * w + 6] = one
    return out


def short_order(bands: Sequence[int] = SHORT_BANDS) -> np.ndarray:
    """For each line of the coded order (band, window, frequency) its place among the subbands' windows."""
    return np.array([f // 6 * 18 + w * 6 + f % 6 for a, b in zip(bands, bands[1:], strict=False) for w in range(3) for f in range(a, b)])


def alias_matrix(size: int = HOPS, bands: int = BANDS) -> np.ndarray:
    """The encoder's butterflies across the subbands' borders."""
    out = np.eye(size * bands)
    for border in range(size, size * bands, size):
        for i, c in enumerate(ALIAS):
            cs, ca = 1 / np.sqrt(1 + c * c), c / np.sqrt(1 + c * c)
            up, down = border - 1 - i, border + i
            out[[up, down, down, up], [up, down, up, down]] = cs, cs, ca, -ca
    return out


def granule_matrix(window: np.ndarray, short: bool = False) -> np.ndarray:
    """BEFORE + GRANULE samples to the granule's lines: long ones by frequency, short ones in the coded order."""
    hop = polyphase_matrix(window)
    inversion = np.where((np.arange(HOPS)[:, None] % 2 == 1) & (np.arange(BANDS)[None, :] % 2 == 1), -1.0, 1.0)
    subbands = np.zeros((BEFORE + GRANULE, 2 * HOPS, BANDS))
    for h in range(2 * HOPS):
        subbands[h * BANDS : h * BANDS + TAPS, h] = hop * inversion[h % HOPS]
    lines = np.einsum("shb,hl->sbl", subbands, short_matrix() if short else mdct_matrix(18, T.sine_window(36)), optimize=True).reshape(BEFORE + GRANULE, GRANULE)
    return lines[:, short_order()] if short else lines @ alias_matrix()
