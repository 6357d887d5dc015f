"""Transforms of long frames: one matrix product for each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mdct_matrix(lines: int, window: Sequence[float] | None = None, scale: float = 1.0) -> np.ndarray:
    n, k = np.arange(2 * lines), np.arange(lines)
    basis = scale * np.cos(np.pi / lines * np.outer(n + 0.5 + lines / 2, k + 0.5))
    return basis if window is None else basis * np.asarray(window)[:, None]


def frames(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """One row for each frame of an array column: ``frame`` and ``block``, zero past the end, at least one frame."""
    count = F.greatest(F.ceil(F.size(samples) / hop), F.lit(1))
    numbered = df.withColumn("frame", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    part = F.slice(F.col(samples), F.col("frame") * hop + 1, size)
    padded = F.concat(part, F.array_repeat(F.lit(0.0), size - F.size(part)))
    return numbered.withColumn("block", padded).drop(samples)


def transform(df: DataFrame, column: str, matrix: np.ndarray, out: str) -> DataFrame:
    """Adds the product of each row's array with the matrix; rows of another length, or null, get null."""
    names = df.columns
    rows, lines = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(names.index(column)).cast(pa.list_(pa.float64()))
            right = np.diff(values.offsets.to_numpy()) == rows
            right &= values.is_valid().to_numpy(zero_copy_only=False)
            found = values.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, rows) @ matrix
            ends = np.concatenate([[0], np.cumsum(right)]) * lines
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel()), mask=pa.array(~right))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` array<double>"]))


def resample_taps(source: int, target: int, frames_in: int, zeros: int = 16) -> list[tuple[int, list[tuple[int, float]]]]:
    """For each output frame, the input frames and weights of a Blackman-windowed sinc, which add up to one."""
    import math

    from ..functions.transforms import blackman

    ratio = source / target
    cut = min(1.0, target / source)
    reach = zeros / cut
    out = []
    for i in range(frames_in * target // source):
        centre = i * ratio
        taps = []
        for j in range(max(0, math.ceil(centre - reach)), min(frames_in - 1, math.floor(centre + reach)) + 1):
            d = (j - centre) * cut
            sinc = 1.0 if d == 0 else math.sin(math.pi * d) / (math.pi * d)
            taps.append((j, sinc * blackman((j - centre) / reach)))
        total = sum(w for _, w in taps)
        out.append((i, [(j, w / total) for j, w in taps]))
    return out


def overlap_add(df: DataFrame, key: str, frame: str, block: str, hop: int) -> DataFrame:
    """Sums overlapping frames: key, sample index and value."""
    long = df.select(key, frame, F.posexplode(block).alias("_i", "_x"))
    return long.groupBy(key, (F.col(frame) * hop + F.col("_i")).alias("i")).agg(F.sum("_x").alias("value"))


def autocorrelation(x: Column, n: int, lags: int) -> Column:
    from ..functions.pcm import dot

    return F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: dot(F.slice(x, F.lit(1), F.lit(n) - k), F.slice(x, k + 1, F.lit(n) - k)))


def levinson(r: Column, order: int, stop: float = 0.0) -> Column:
    """Predictor coefficients from autocorrelations, by Levinson and Durbin's recursion, as one expression.

    Zero energy gives zero coefficients, and no further one is found where less than
    the share ``stop`` of the energy is left.
    """
    from ..functions.pcm import total

    start = F.struct(F.get(r, 0).alias("e"), F.array().cast("array<double>").alias("a"))

    def step(state: Column, i: Column) -> Column:
        a, e = state["a"], state["e"]
        acc = F.get(r, i + 1) - total(F.transform(a, lambda c, j: c * F.get(r, i - j)))
        k = F.when((e > 0) & (e >= stop * F.get(r, 0)), acc / e).otherwise(0.0)
        updated = F.concat(F.transform(a, lambda c, j: c - k * F.get(a, i - 1 - j)), F.array(k))
        return F.struct((e * (1 - k * k)).alias("e"), updated.alias("a"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), start, step)["a"]
