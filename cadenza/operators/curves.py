"""Masking curves, block schedules, residue books and linear prediction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pcm

#: Blocks and residue grids; fixed values of the format.
LONG, SHORT, SHORTS = 1024, 128, 8
FINE, COARSE, LEVELS, FINE_MOST = (-16.0, 0.25), (-256.0, 4.0), 128, 15.0


def approximate_db(x: Column) -> Column:
    """20 log10 |x| from the exponent and fraction of a 32-bit float, as a line through its bits."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    bits = (power + 126 + size / F.pow(F.lit(2.0), power)) * 8388608
    return F.when(size > 0, bits).otherwise(0.0) * 7.177114e-7 - 764.6162


def from_db(db: Column) -> Column:
    return F.exp(db * 0.11512925)


def from_bark(z: Column) -> Column:
    return 102.0 * z - 2.0 * z * z + 0.4 * z * z * z + F.pow(F.lit(1.46), z) - 1.0


def from_mel(m: Column) -> Column:
    return 1000.0 * F.exp(m / 1442.695) - 1000.0


def from_octave(o: Column) -> Column:
    return F.exp((o + 5.965784) * math.log(2))


def bark_of(hz: float) -> float:
    return 13.1 * math.atan(0.00074 * hz) + 2.24 * math.atan(hz * hz * 1.85e-8) + 1e-4 * hz


def bark_windows(bins: int, rate: int, low: float, high: float, least_low: int, least_high: int) -> list[tuple[int, int]]:
    """For each bin the first and last bins about it within so many Bark, but at least so many bins away."""
    hz = rate // (2 * bins)
    bark = {k: bark_of(hz * k) for k in range(-99, bins + 2)}
    out = []
    for i in range(bins):
        first = next((k for k in range(-99, bins + 2) if bark[k] >= bark[i] - low), bins)
        last = next((k for k in range(1, bins + 1) if bark[k] >= bark[i] + high), bins + 1)
        out.append((max(-99, min(i - least_low, first)) - 1, min(bins + 1, max(i + least_high, last)) - 1))
    return out


def mixed_mask(noise: Column, tone: Column, offset: Column, attenuation: float, ceiling: float) -> Column:
    """The louder of the noise floor, raised and capped, and the tone mask."""
    return F.greatest(F.least(noise + offset, F.lit(ceiling)), tone + attenuation)


def companding_gain(noise: Column, line: Column, offset: Column, strength: float, ceiling: float = 0.0, knee: float = -17.2) -> Column:
    """Gain of a line by how far the noise floor stands over it."""
    over = F.least(noise + offset, F.lit(ceiling)) - line - knee
    down = 1 - over * (0.005 * strength)
    return F.when(over > 0, F.when(down < 0, 0.0001).otherwise(down)).otherwise(1 - over * (0.0003 * strength))


def sharp_onset(energies: Column, ratio: float = 8.0, floor: float = 1e-3, share: float = 0.05) -> Column:
    """Whether a part's energy is so many times the mean of all before it, and a share of the loudest."""
    top = F.array_max(energies)

    def step(state: Column, e: Column) -> Column:
        mean = F.greatest(state["sum"] / F.greatest(state["n"], F.lit(1.0)), top * floor)
        hit = (state["n"] > 0) & (e > ratio * mean) & (e > share * top)
        return F.struct((state["sum"] + e).alias("sum"), (state["n"] + 1).alias("n"), (state["hit"] | hit).alias("hit"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"), F.lit(False).alias("hit"))
    return (top > 0) & F.aggregate(energies, start, step, lambda s: s["hit"])


def schedule(slots: DataFrame, key: str, order: str, transient: str) -> DataFrame:
    """Blocks of each key: long ones with their window flags, and eight short ones for each transient slot.

    A run's short blocks go on from its first slot, so the run's start is carried to
    all its slots by an island number.
    """
    w = Window.partitionBy(key).orderBy(order)
    quiet = lambda c: ~F.coalesce(c, F.lit(False))
    island = F.col(order) - F.row_number().over(Window.partitionBy(key, transient).orderBy(order))
    df = slots.withColumns({"_left": quiet(F.lag(transient).over(w)), "_right": quiet(F.lead(transient).over(w)), "_island": island})
    df = df.withColumn("_first", F.min(order).over(Window.partitionBy(key, transient, "_island")))
    first = (LONG + SHORT) // 2
    long = F.array(F.struct(((F.col(order) + 1) * LONG).alias("centre"), F.lit(True).alias("long"), F.col("_left").alias("left"), F.col("_right").alias("right")))
    short = F.transform(F.sequence(F.lit(0), F.lit(SHORTS - 1)), lambda j: F.struct((F.col("_first") * LONG + first + SHORT * (SHORTS * (F.col(order) - F.col("_first")) + j)).alias("centre"), F.lit(False).alias("long"), F.lit(False).alias("left"), F.lit(False).alias("right")))
    return df.select(key, F.explode(F.when(F.col(transient), short).otherwise(long)).alias("b")).select(key, "b.*")


def grid_entry(x: Column, grid: tuple[float, float]) -> Column:
    """The nearest entry of a uniform grid."""
    return F.greatest(F.least(F.round((x - grid[0]) / grid[1]), F.lit(float(LEVELS - 1))), F.lit(0.0)).cast("long")


def cascade(part: Column) -> Column:
    """(stage, entry) of the values of a partition: nothing if silent, one stage if quiet, else a coarse one and what is left."""
    top = pcm.max_abs(part)
    fine = lambda x: F.struct(F.lit("fine").alias("stage"), grid_entry(x, FINE).alias("entry"))
    both = F.flatten(F.transform(part, lambda x: F.array(F.struct(F.lit("coarse").alias("stage"), grid_entry(x, COARSE).alias("entry")), fine(x - (grid_entry(x, COARSE) * COARSE[1] + COARSE[0])))))
    return F.when(top == 0, F.array().cast("array<struct<stage:string,entry:bigint>>")).when(top <= FINE_MOST, F.transform(part, fine)).otherwise(both)


def damped(taps: Column, by: float = 0.99) -> Column:
    """Predictor taps with their signs turned, each damped once more than the one before."""
    return F.transform(taps, lambda a, k: -a * F.pow(F.lit(by), k + 1))


def predicted(coefficients: Column, last: Column, n: int) -> Column:
    """n samples that follow the last ones, newest last, by linear prediction."""
    m = F.size(coefficients)

    def step(state: Column, _: Column) -> Column:
        y = -pcm.total(F.transform(coefficients, lambda c, j: c * F.get(state, F.size(state) - 1 - j)))
        return F.concat(state, F.array(y))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.slice(last, -m, m), step, lambda s: F.slice(s, m + 1, F.lit(n)))
