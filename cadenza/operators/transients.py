"""Masked transients: recursive filters over whole rows, by blocks of samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: 6 * 64 / x as trained on harmonic means; fixed values of the codec.
INVERSE = (
    255, 255, 156, 110, 86, 70, 59, 51, 45, 40, 37, 33, 31, 28, 26, 25,
    23, 22, 21, 20, 19, 18, 17, 16, 16, 15, 15, 14, 13, 13, 12, 12,
    12, 12, 11, 11, 11, 10, 10, 10, 9, 9, 9, 9, 9, 9, 8, 8,
    8, 8, 8, 7, 7, 7, 7, 7, 7, 6, 6, 6, 6, 6, 6, 6,
    6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5, 5, 5, 5, 5, 5,
    5, 5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4,
    4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 3, 3,
    3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 2,
)


@lru_cache
def _block(forward: tuple[float, ...], back: tuple[float, ...], size: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``size`` inputs and the state before them add to the outputs and to the state after them."""
    order = len(back)
    unit = np.eye(size + order)
    state, out = unit[:, size:], np.empty((size + order, size))
    for i in range(size):
        out[:, i] = forward[0] * unit[:, i] + state[:, 0]
        later = np.hstack([state[:, 1:], np.zeros((size + order, 1))])
        state = later + np.outer(unit[:, i], forward[1:]) - np.outer(out[:, i], back)
    return out, state


def recursive(x: np.ndarray, forward: Sequence[float], back: Sequence[float], size: int = 64) -> np.ndarray:
    """Rows through y[i] = sum forward[k] x[i - k] - sum back[k] y[i - 1 - k], from silence.

    A block of samples and the state before it give the block's outputs and the state
    after it by one matrix product for all rows.
    """
    back = tuple(back)
    forward = tuple(forward) + (0.0,) * (len(back) + 1 - len(forward))
    out, after = _block(forward, back, size)
    y, state = np.empty_like(x), np.zeros((len(x), len(back)))
    for at in range(0, x.shape[1], size):
        part = x[:, at : at + size]
        joined = np.hstack([part, np.zeros((len(x), size - part.shape[1])), state])
        y[:, at : at + size] = (joined @ out)[:, : part.shape[1]]
        state = joined @ after
    return y


def smoothed(x: np.ndarray, share: float) -> np.ndarray:
    """Each step goes the share of the way to the next value, from zero."""
    return recursive(x, (share,), (share - 1,))


def metric(x: np.ndarray, weak: bool = False) -> np.ndarray:
    """Energy over the harmonic mean of what masks it, for each row: high-passed, in pairs, smoothed forward (slower where weak transients are allowed), then backward."""
    y = recursive(x, (1.0, -2.0, 1.0), (-1.0, 0.5))
    y[:, :12] = 0.0
    half = x.shape[1] // 2
    if half <= 17:
        return np.zeros(len(x), np.int64)
    pairs = (y[:, : 2 * half].reshape(len(x), half, 2) ** 2).sum(2)
    mask = smoothed(smoothed(pairs, 0.03125 if weak else 0.0625)[:, ::-1], 0.125)[:, ::-1]
    norm = half / (1e-15 + np.sqrt(pairs.sum(1) * mask.max(1) * 0.5 * half))
    kept = mask[:, 12 : half - 5 : 4]
    classes = np.clip(np.floor(64 * norm[:, None] * (kept + 1e-15)), 0, 127).astype(np.int64)
    return 64 * 4 * np.array(INVERSE)[classes].sum(1) // (6 * (half - 17))


def estimate(found: np.ndarray) -> np.ndarray:
    """How much more a frame of this metric may cost, 0 to 1."""
    return np.sqrt(np.maximum(0.0, 0.0069 * np.minimum(163.0, np.maximum(0.0, np.sqrt(27.0 * found) - 42)) - 0.139))


_FIELDS = [("metric", pa.int64()), ("channel", pa.int64()), ("transient", pa.bool_()), ("weak", pa.bool_()), ("estimate", pa.float64())]


def transients(df: DataFrame, channels: Sequence[str], out: str, weak: bool = False) -> DataFrame:
    """Adds metric, its channel (the first of equal ones), flags and estimate of rows of samples.

    Rows where a channel is null, or where channels differ in length, get null; null samples
    count as zero.  Nothing is shuffled, and a batch needs room for its own samples a few times.
    """
    names, kind = df.columns, pa.struct(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(names.index(c)).cast(pa.list_(pa.float64())) for c in channels]
            sizes = np.array([h.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for h in held])
            right = (sizes >= 0).all(0) & (sizes == sizes[0]).all(0)
            rows = np.zeros((len(channels), batch.num_rows), np.int64)
            for n in np.unique(sizes[0][right]):
                at = np.flatnonzero(right & (sizes[0] == n))
                for k, h in enumerate(held):
                    x = h.take(pa.array(at)).flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), int(n))
                    rows[k, at] = metric(x, weak)
            top = rows.max(0)
            strong = top > 200
            lighter = strong & (top < 600) & weak
            values = [pa.array(v, t) for v, (_, t) in zip((top, rows.argmax(0), strong & ~lighter, lighter, estimate(top)), _FIELDS, strict=True)]
            made = pa.StructArray.from_arrays(values, fields=list(kind), mask=pa.array(~right))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` struct<metric: bigint, channel: bigint, transient: boolean, weak: boolean, estimate: double>"]))
