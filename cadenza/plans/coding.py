"""Filterbank corrections, scales, curves and sequential coders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import pcm
from ..functions import transforms as T
from ..operators import coding
from ..sources.adaptors import frame_facts, pcm_blocks, stereo_blocks
from .quality import _r
from .registry import FRAMES, PX, STEREO, query, rounded
from .spectra import _lines

#: Coefficients from which the alias butterflies' are made; fixed values of the format.
ALIAS = (-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037)
CS = [1 / math.sqrt(1 + c * c) for c in ALIAS]
CA = [c / math.sqrt(1 + c * c) for c in ALIAS]
_BUTTERFLY = ", ".join(f"({k}, {s!r}::DOUBLE, {a!r}::DOUBLE)" for k, (s, a) in enumerate(zip(CS, CA, strict=True)))


@query(f"""WITH {PX}, c(k, cs, ca) AS (VALUES {_BUTTERFLY}), j AS (SELECT a.block, a.i AS up, b.i AS down, a.x * cs + b.x * ca AS u, b.x * cs - a.x * ca AS d FROM px a JOIN c ON a.i % 16 = 15 - c.k AND a.i < 48 JOIN px b ON b.block = a.block AND b.i = a.i + 2 * c.k + 1)
SELECT px.block, px.i, {rounded('x + coalesce(j1.u - x, 0) + coalesce(j2.d - x, 0)')} AS value FROM px LEFT JOIN j j1 ON j1.block = px.block AND j1.up = px.i LEFT JOIN j j2 ON j2.block = px.block AND j2.down = px.i""")
def alias_reduction(spark, sf_dir):
    """The encoder's eight butterflies across each boundary of bands of 16 lines."""
    cs, ca = T.constants(CS), T.constants(CA)

    def line(x, i):
        k_up, k_down = 15 - i % 16, i % 16
        up = (k_up < 8) & (i < 48)
        down = (k_down < 8) & (i >= 16)
        above = x * F.get(cs, k_up) + F.get(F.col("samples"), i + 2 * k_up + 1) * F.get(ca, k_up)
        below = x * F.get(cs, k_down) - F.get(F.col("samples"), i - 2 * k_down - 1) * F.get(ca, k_down)
        return F.when(up, above).when(down, below).otherwise(x)

    return _lines(pcm_blocks(spark, sf_dir), "block", F.transform("samples", line), "i")


@query(f"WITH {PX} SELECT block, i, {rounded('CASE WHEN (i // 8) % 2 = 1 AND i % 2 = 1 THEN -x ELSE x END')} AS value FROM px")
def frequency_inversion(spark, sf_dir):
    """Odd samples of odd subbands change sign."""
    value = F.transform("samples", lambda x, i: F.when((F.floor(i / 8) % 2 == 1) & (i % 2 == 1), -x).otherwise(x))
    return _lines(pcm_blocks(spark, sf_dir), "block", value, "i")


_HZ = "(50.0::DOUBLE + 40 * k)"


@query(f"""SELECT k::BIGINT AS k, {rounded(f'13.1 * atan(0.00074 * {_HZ}) + 2.24 * atan({_HZ} * {_HZ} * 1.85e-8) + 1e-4 * {_HZ}')} AS bark, {rounded(f'ln(1 + {_HZ} * 0.001) * 1442.695')} AS mel, {rounded(f'ln({_HZ}) * 1.442695 - 5.965784')} AS octave FROM (SELECT unnest(range(500)) AS k)""")
def psychoacoustic_scales(spark, sf_dir):
    """Bark, mel and octave scales of frequencies."""
    hz = 50.0 + 40 * F.col("id")
    bark = 13.1 * F.atan(0.00074 * hz) + 2.24 * F.atan(hz * hz * 1.85e-8) + 1e-4 * hz
    return spark.range(500).select(F.col("id").alias("k"), _r(bark).alias("bark"), _r(F.ln(1 + hz * 0.001) * 1442.695).alias("mel"), _r(F.ln(hz) * 1.442695 - 5.965784).alias("octave"))


@query(f"WITH {STEREO} SELECT pair, {rounded('sum(least(l, r))')} AS low, {rounded('sum(greatest(l, r))')} AS high, {rounded('sum(l + 0.25 * r)')} AS raised FROM st GROUP BY pair")
def curve_mix(spark, sf_dir):
    """Lower and upper envelope of two curves, and one raised by a part of the other, summed."""
    mix = lambda f: pcm.total(F.zip_with("left", "right", f))
    return stereo_blocks(spark, sf_dir).select("pair", _r(mix(lambda a, b: F.least(a, b))).alias("low"), _r(mix(lambda a, b: F.greatest(a, b))).alias("high"), _r(mix(lambda a, b: a + 0.25 * b)).alias("raised"))


@query(f"""WITH {PX}, y AS (SELECT block, i, greatest(100 * abs(x), 1.0::DOUBLE) AS y FROM px), m AS (SELECT a.block, a.i, sum(pow(b.y, 2)) AS n, sum(pow(b.y, 2) * b.i) AS sx, sum(pow(b.y, 2) * b.i * b.i) AS sxx, sum(pow(b.y, 3)) AS sy, sum(pow(b.y, 3) * b.i) AS sxy FROM y a JOIN y b ON b.block = a.block AND b.i BETWEEN a.i - 6 AND a.i + 6 GROUP BY a.block, a.i)
SELECT block, i, {rounded('greatest((sy * sxx - sx * sxy + (n * sxy - sx * sy) * i) / (n * sxx - sx * sx), 0.0::DOUBLE)', 4)} AS floor FROM m""")
def noise_floor(spark, sf_dir):
    """Weighted line through the levels of the bins within six of each."""
    import numpy as np
    import pyarrow as pa

    at = np.arange(64)
    low, high = np.maximum(at - 6, 0), np.minimum(at + 7, 64)

    def run(batches):
        for batch in batches:
            levels = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            floors = np.array([coding.noise_floor(100 * np.abs(row), low, high) for row in levels]).reshape(-1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), 64)), pa.array(np.tile(at, n)), pa.array(floors)], names=["block", "i", "floor"])

    found = pcm_blocks(spark, sf_dir).select("block", "samples").mapInArrow(run, "block long, i long, floor double")
    return found.withColumn("floor", _r("floor", 4))


@query(f"""WITH RECURSIVE {FRAMES}, p AS (SELECT stream_id, frame, (payload // 4)::BIGINT AS y0, lead(payload // 4) OVER (PARTITION BY stream_id ORDER BY frame) AS y1 FROM fr),
s AS (SELECT stream_id, frame, y0, y1, trunc((y1 - y0) / 10.0)::BIGINT AS base FROM p WHERE y1 IS NOT NULL),
l AS (SELECT stream_id, frame, 0 AS x, y0 AS y, 0::BIGINT AS err, base, abs(y1 - y0) - abs(base) * 10 AS rest, CASE WHEN y1 < y0 THEN base - 1 ELSE base + 1 END AS step FROM s
UNION ALL SELECT stream_id, frame, x + 1, CASE WHEN err + rest >= 10 THEN y + step ELSE y + base END, CASE WHEN err + rest >= 10 THEN err + rest - 10 ELSE err + rest END, base, rest, step FROM l WHERE x < 9)
SELECT stream_id, frame, x::BIGINT AS x, y::BIGINT AS y FROM l""")
def floor_lines(spark, sf_dir):
    """Integer lines between the frames' levels, ten points each.

    The error-accumulating line has a closed form: after x steps it has moved by
    base x and one more for each time the rest has filled the width.
    """
    from pyspark.sql import Window

    level = F.floor(F.col("payload") / 4)
    after = F.lead(level).over(Window.partitionBy("stream_id").orderBy("frame"))
    lines = frame_facts(spark, sf_dir).select("stream_id", "frame", level.alias("y0"), after.alias("y1")).where("y1 is not null")
    d = F.col("y1") - F.col("y0")
    size = F.floor(F.abs(d) / 10)
    lines = lines.withColumns({"sign": F.when(d < 0, -1).otherwise(1), "base": size, "rest": F.abs(d) - size * 10}).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return lines.select("stream_id", "frame", F.col("x").cast("long").alias("x"), (F.col("y0") + F.col("sign") * (F.col("base") * F.col("x") + F.floor(F.col("rest") * F.col("x") / 10))).cast("long").alias("y"))


@query("SELECT vec_id AS block, 64::BIGINT AS symbols, true AS whole FROM embeddings")
def range_coder(spark, sf_dir):
    """Quantised blocks through the range coder and back."""
    import numpy as np
    import pandas as pd

    top = 40

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                symbols = np.clip(np.round(np.asarray(r.samples) * 40).astype(int) + top // 2, 0, top - 1).tolist()
                total = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top) + 1)]).tolist()
                coder = coding.RangeEncoder()
                for s in symbols:
                    coder.put(total[s], total[s + 1], total[-1])
                decoder = coding.RangeDecoder(coder.finish())
                rows.append((r.block, len(symbols), [decoder.get(total) for _ in symbols] == symbols))
            yield pd.DataFrame(rows, columns=["block", "symbols", "whole"])

    return pcm_blocks(spark, sf_dir).select("block", "samples").mapInPandas(run, "block long, symbols long, whole boolean")
