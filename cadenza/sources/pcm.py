"""Sample buffers of the file codecs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .errors import AudioError


@dataclass
class Pcm:
    """Interleaved samples, in [-1, 1] by convention."""

    sample_rate: int
    channels: int
    samples: np.ndarray

    def __post_init__(self):
        self.samples = np.asarray(self.samples, np.float32)
        if self.sample_rate <= 0 or self.channels <= 0:
            raise AudioError("InvalidPcm", "rate and channels must not be zero")
        if len(self.samples) % self.channels:
            raise AudioError("InvalidPcm", "samples must fill whole frames")

    @property
    def frames(self) -> int:
        return len(self.samples) // self.channels


def to_integers(samples: np.ndarray, bits: int) -> np.ndarray:
    """Clamped, scaled by 2^(bits-1) - 1 and rounded half away from zero; -1 is the lowest value."""
    top = (1 << (bits - 1)) - 1
    x = np.clip(np.nan_to_num(samples.astype(np.float32)), np.float32(-1), np.float32(1))
    scaled = x * np.float32(top)
    out = np.trunc(scaled.astype(np.float64) + np.copysign(0.5, scaled)).astype(np.int64)
    return np.where(x <= -1, -top - 1, out)


def to_floats(values: np.ndarray, bits: int) -> np.ndarray:
    """Negatives by 2^(bits-1), others by 2^(bits-1) - 1."""
    half = float(1 << (bits - 1))
    return np.where(values < 0, values / half, values / (half - 1)).astype(np.float32)
