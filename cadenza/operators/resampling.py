"""Resampling of streams of any length: blocks with what they need of their neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZEROS = 16
#: Weights gathered at once, so that a task's memory has a bound.
GATHERED = 1 << 22


def kernel(distance: np.ndarray, source: int, target: int) -> np.ndarray:
    """Weight of a sample at a distance, in samples of the source: a sinc of 16 zero crossings under Blackman's window."""
    cut = min(1.0, target / source)
    r = distance * cut / ZEROS
    return np.where(abs(r) > 1, 0.0, cut * np.sinc(distance * cut) * (0.42 + 0.5 * np.cos(np.pi * r) + 0.08 * np.cos(2 * np.pi * r)))


def reach(source: int, target: int) -> int:
    return math.ceil(ZEROS / min(1.0, target / source))


def with_halo(df: DataFrame, keys: Sequence[str], block: str, samples: str, size: int, halo: int) -> DataFrame:
    """Blocks with the ``halo`` samples before and after them: ``before``, ``samples`` and ``after``; silence where a block is missing.

    Every block sends its ends on to the blocks that need them, so rows meet by key and
    block, never by stream, and a stream of any length is many tasks.
    """
    span = -(-halo // size)
    steps = F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("_step")
    sent = df.select(*keys, F.col(block).alias("_from"), F.col(samples).alias("_x"), steps).select(
        *keys, (F.col("_from") + F.col("_step")).alias(block), "_step",
        # the last samples go forward, the first ones back
        F.when(F.col("_step") == 0, F.col("_x"))
        .when(F.col("_step") > 0, F.slice("_x", F.greatest(F.lit(1), F.col("_step") * size - halo + 1), size))
        .otherwise(F.slice("_x", 1, F.least(F.lit(size), halo + (F.col("_step") + 1) * size))).alias("_x"),
    )
    part = lambda k: F.max(F.when(F.col("_step") == k, F.col("_x")))
    met = sent.groupBy(*keys, block).agg(*(part(k).alias(f"_p{k + span}") for k in range(-span, span + 1))).where(F.col(f"_p{span}").isNotNull())

    def side(steps: Sequence[int], lengths: Sequence[int]):
        return F.concat(*(F.coalesce(f"_p{k + span}", F.array_repeat(F.lit(0.0), n)) for k, n in zip(steps, lengths, strict=True)))

    far = [min(size, halo - (k - 1) * size) for k in range(1, span + 1)]
    back = side(range(span, 0, -1), far[::-1])
    ahead = side(range(-1, -span - 1, -1), far)
    return met.select(*keys, block, back.alias("before"), F.col(f"_p{span}").alias("samples"), ahead.alias("after"))


def resample(df: DataFrame, keys: Sequence[str], block: str, samples: str, size: int, source: int, target: int) -> DataFrame:
    """Streams at another rate: keys, ``block``, ``start`` (number of the first sample made) and ``value`` (array).

    Block k of a stream, from 0, holds samples k * size on: ``size`` of them, the last one
    maybe fewer.  Null samples and missing blocks are silence, and a missing block makes no
    row; rows with a null key, block or array are passed over, and of a repeated block the
    greatest array counts.  Weights are summed over the samples inside the stream alone, so
    its ends keep their level.  Blocks that start at the same phase share their weights.
    """
    if source <= 0 or target <= 0 or size <= 0 or not keys:
        raise ValueError("rates and sizes must be positive, and streams have keys")
    common = math.gcd(source, target)
    up, down = target // common, source // common
    halo = reach(source, target) + 1
    present = df.select(*keys, block, F.slice(samples, 1, size).alias("samples")).dropna(subset=[*keys, block, "samples"])
    padded = present.withColumn("samples", F.concat(F.transform("samples", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), size - F.size("samples"))))
    held = with_halo(padded, keys, block, "samples", size, halo)
    # only blocks near its end need to know a stream's length, so they are met by key and block too
    ends = present.groupBy(*keys).agg(F.max(F.col(block) * size + F.size("samples")).alias("end"))
    last = F.floor((F.col("end") - 1) / size)
    near = ends.select(*keys, F.explode(F.sequence(last - (halo // size + 1), last)).alias(block), "end")
    held = held.join(near, [*keys, block], "left")
    names = list(keys)
    lead = np.arange(-halo, halo + 1)

    def made(first: int, end: int, x: np.ndarray) -> tuple[int, np.ndarray]:
        """Rows of x begin at the sample ``first`` less the halo."""
        last = (end * up * 2 + down) // (2 * down)
        lo, hi = -(-first * up // down), min(-(-(first + size) * up // down), last)
        m = np.arange(lo, max(lo, hi))
        centre = m * down // up
        at = centre[:, None] + lead
        w = kernel((m * down % up / up)[:, None] - lead, source, target)
        w = np.where((at >= 0) & (at < end), w, 0.0)
        sums = w.sum(1)
        w /= np.where(abs(sums) > 1e-12, sums, np.inf)[:, None]
        local = np.clip(at - first + halo, 0, x.shape[1] - 1)
        many = max(1, GATHERED // max(1, w.size))
        return lo, np.vstack([np.einsum("rmk,mk->rm", x[i : i + many][:, local], w) for i in range(0, len(x), many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(len(names) + ("block", "before", "samples", "after", "end").index(c))
            sides = [get(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("before", "samples", "after")]
            x = np.hstack(sides)
            first = get("block").to_numpy() * size
            end = get("end").fill_null(np.iinfo(np.int64).max).to_numpy()
            inner = (first >= halo) & (first + size + halo < end)
            # blocks away from both ends differ in their phase alone; the others go one by one
            groups = [np.flatnonzero(inner & (first % down == p)) for p in np.unique(first[inner] % down)] + [np.array([i]) for i in np.flatnonzero(~inner)]
            starts, values = np.empty(batch.num_rows, np.int64), [None] * batch.num_rows
            for rows in groups:
                begin = int(first[rows[0]])
                lo, y = made(begin, int(end[rows[0]]) if not inner[rows[0]] else begin + size + halo + 1, x[rows])
                starts[rows] = lo + (first[rows] - begin) // down * up
                for i, v in zip(rows, y, strict=True):
                    values[i] = v
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), get("block"), pa.array(starts), pa.array(values, pa.list_(pa.float64()))], names=[*names, "block", "start", "value"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*names).schema.fields]
    ordered = held.select(*names, F.col(block).cast("long").alias("block"), "before", "samples", "after", F.col("end").cast("long").alias("end"))
    return ordered.mapInArrow(run, ", ".join([*fields, "block long, start long, value array<double>"]))
