"""Transients, block schedules, stereo and noise budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pcm


def segment_energies(samples: Column, n: int, segments: int) -> Column:
    """Sums of squares by segment: sample i belongs to i * segments div n."""
    bounds = [next(i for i in range(n + 1) if i == n or i * segments // n >= s) for s in range(segments)] + [n]
    return F.array(*(pcm.total(F.slice(samples, a + 1, b - a), lambda x: x * x) for a, b in zip(bounds, bounds[1:], strict=False)))


def segment_sums(samples: Column, size: int, segments: int) -> Column:
    """Sums of squares of so many segments of a size; what is left over at the end is ignored."""
    return F.array(*(pcm.total(F.slice(samples, s * size + 1, size), lambda x: x * x) for s in range(segments)))


def attack_ratio(energies: Column, floor: float = 1e-12) -> Column:
    """Largest ratio of an energy to the mean of those before it, 1 at least."""

    def step(state: Column, e: Column) -> Column:
        mean = state["sum"] / F.greatest(state["n"], F.lit(1.0))
        ratio = F.when(mean > floor, e / mean).otherwise(1.0)
        return F.struct((state["sum"] + e).alias("sum"), (state["n"] + 1.0).alias("n"), F.greatest(state["best"], ratio).alias("best"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"), F.lit(1.0).alias("best"))
    return F.aggregate(energies, start, step, lambda s: s["best"])


def granule_transient(energies: Column, ratio: float = 8.0, floor: float = 1e-3, share: float = 0.05) -> Column:
    top = F.array_max(energies)
    pairs = F.zip_with(F.slice(energies, 2, F.size(energies) - 1), F.slice(energies, 1, F.size(energies) - 1), lambda e, before: F.struct(e.alias("e"), before.alias("b")))
    return F.exists(pairs, lambda p: (p["e"] > ratio * F.greatest(p["b"], top * floor)) & (p["e"] > share * top))


def block_schedule(flags: DataFrame, key: str, order: str, transient: str) -> DataFrame:
    """Adds block_type: a frame between two transients is short too; a long block before a short one starts, one after it stops."""
    w = Window.partitionBy(key).orderBy(order)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    after = lambda c: F.coalesce(F.lead(c).over(w), F.lit(False))
    short = flags.withColumn("_short", F.col(transient) | (before(transient) & after(transient)))
    kind = F.when(F.col("_short"), "short").when(after("_short"), "start").when(before("_short"), "stop").otherwise("long")
    return short.withColumn("block_type", kind).drop("_short")


def short_runs(flags: DataFrame, key: str, order: str, short: str) -> DataFrame:
    """Runs of equal flags: first frame, frames, and blocks, eight for each short frame."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(key, short).orderBy(order))
    runs = flags.withColumn("_island", island).groupBy(key, short, "_island").agg(F.min(order).alias("first"), F.count("*").alias("frames"))
    return runs.select(key, "first", "frames", (F.col("frames") * F.when(F.col(short), 8).otherwise(1)).cast("long").alias("blocks"), short)


def side_fraction(left: Column, right: Column) -> Column:
    """Share of the side's energy in that of orthonormal mid and side; 0 for silence."""
    mid = pcm.total(F.zip_with(left, right, lambda a, b: (a + b) * (a + b) / 2))
    side = pcm.total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b) / 2))
    return F.when(mid + side <= 0, 0.0).otherwise(side / (mid + side))


def square_polar(left: Column, right: Column) -> Column:
    """The larger channel, and the difference signed so that it can be undone."""
    larger = F.abs(left) > F.abs(right)
    magnitude = F.when(larger, left).otherwise(right)
    angle = F.when(F.when(larger, left > 0).otherwise(right > 0), left - right).otherwise(right - left)
    return F.struct(magnitude.alias("magnitude"), angle.alias("angle"))


def allowed_noise(lines: Column, power: Column, threshold: Column) -> Column:
    """Band energy by the ratio of masked to own power; 1e-12 for a silent band, null where the bins hold no power."""
    energy, own, masked = pcm.total(lines, lambda x: x * x), pcm.total(power), pcm.total(threshold)
    return F.when(energy <= 0, 1e-12).when(own <= 0, F.lit(None)).otherwise(masked / own * energy)
