"""Budgets, padding, allocation, the bit reservoir and step selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .fold import ordered_fold


def frame_bytes(kbps: Column | int, rate: Column | int, padding: Column | int = 0, low_rate: bool = False) -> Column:
    """Layer III frame length: 144 (72 at the low sampling rates) kbps 1000 / rate, and the padding byte."""
    slots = (72 if low_rate else 144) * 1000
    return F.floor(F.lit(kbps) * slots / F.lit(rate)).cast("long") + F.lit(padding)


def frame_budget(bits_per_second: Column, rate: Column, samples: int = 1024, least: int = 7) -> Column:
    """Bytes of a frame at a bit rate, rounded up, with room for its header at least."""
    return F.greatest(F.ceil(bits_per_second * samples / (rate * 8)), F.lit(least)).cast("long")


def payload_capacity(frame: Column, stereo: Column, crc: Column, low_rate: bool = False) -> Column:
    """Frame less header, checksum and side information."""
    side = F.when(stereo, 17 if low_rate else 32).otherwise(9 if low_rate else 17)
    return frame - 4 - F.when(crc, 2).otherwise(0) - side


def padded(frame: Column, remainder: int, rate: int) -> Column:
    """Whether frame i of a constant-rate stream has a padding byte, in closed form."""
    return F.floor((frame + 1) * remainder / rate) - F.floor(frame * remainder / rate)


def reservoir(frames: DataFrame, key: str, order: str, payload: str, capacity: int, most: int = 511, target_bits: str | None = None) -> DataFrame:
    """The bit reservoir of each stream: what every frame may use, begins at and leaves.

    With targets, a frame may use clamp((target + 7) div 8, 1, capacity + begin) bytes;
    a payload over that falls back to the whole budget, and ``targeted`` is false.

    begin = min(reservoir, most); budget = capacity + begin; used = min(payload, budget);
    the next reservoir is begin + capacity - used, which is a clamped sum, so a stream of
    any length runs by blocks in many tasks.
    """
    rows = frames.select(key, F.col(order).cast("long").alias(order), F.col(payload).cast("long").alias("_p"), (F.col(target_bits) if target_bits else F.lit(None)).cast("long").alias("_t"))
    spare = F.lit(capacity) - F.col("_p")
    found = scan.clamped(rows, key, order, spare, F.lit(0), F.greatest(F.lit(most) + spare, F.lit(0)), 0, "_left")
    begin = F.least("_left", F.lit(most))
    whole = begin + capacity
    aim = F.greatest(F.least(F.floor((F.col("_t") + 7) / 8), whole), F.lit(1))
    targeted = F.col("_t").isNotNull() & (F.col("_p") <= aim)
    budget = F.when(targeted, aim).otherwise(whole).cast("long")
    used = F.least("_p", whole)
    return found.select(key, order, begin.alias("main_data_begin"), budget.alias("budget"), used.alias("used"), (whole - used).alias("reservoir_after"), (F.col("_p") > budget).alias("over"), targeted.alias("targeted"))


def allocate(parts: DataFrame, keys: list[str], order: str, weight: str, total: int, floor: int) -> DataFrame:
    """Splits a total in proportion to weights, with a floor for each part, to the last unit.

    What floors leave is shared out; fractions are rounded down and the largest of
    them get the units left over, the first of equal ones.  Without weight, or where
    the floors take all, parts are even.
    """
    group = Window.partitionBy(*keys)
    n = F.count("*").over(group)
    mass = F.sum(weight).over(group)
    rest = F.lit(total) - n * floor
    even = (mass <= 0) | (rest < 0)
    spare = F.when(even, F.lit(total)).otherwise(rest)
    share = F.when(even, F.lit(1.0) / n).otherwise(F.col(weight) / F.when(mass > 0, mass))
    exact = F.round(spare * share, 9)
    df = parts.withColumns({"_base": F.when(even, 0).otherwise(floor), "_down": F.floor(exact), "_part": exact - F.floor(exact), "_spare": spare})
    left = F.col("_spare") - F.sum("_down").over(group)
    place = F.row_number().over(group.orderBy(F.round("_part", 6).desc(), order))
    return df.withColumn("bits", (F.col("_base") + F.col("_down") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("_base", "_down", "_part", "_spare")


def shaped_target(frames: DataFrame, constrained: Column, bins: int, free: int, floor_bins: int, average_boost: int, temporal: Column, spare: int) -> DataFrame:
    """Adds ``target``: the base target less what stereo saves, with boosts, a floor by depth, damping and at most twice the base.

    frames have base, saving, boost, tf and depth; bins: the lines coded, free: of them
    those that stereo may save, both over all channels; spare: bits a second under 96,000.
    """
    whole = lambda x: x.cast("long")

    def then(name: str, value: Column):
        nonlocal frames
        frames = frames.withColumn(name, value)
        return F.col(name)

    saved = F.least((0.8 * free / bins) * F.col("base"), (F.least("saving", F.lit(1.0)) - 0.1) * (free << 3))
    t = then("_t1", F.col("base") - whole(saved))
    t = then("_t2", t + F.col("boost") - average_boost)
    t = then("_t3", t + whole((F.col("tf") - 0.044) * t))
    t = then("_t4", F.least(t, F.greatest(whole((floor_bins << 3) * F.col("depth")), F.shiftright(t, 2))))
    t = then("_t5", F.when(constrained, F.col("base") + whole(0.67 * (t - F.col("base")))).otherwise(t))
    t = then("_t6", F.when(F.col("tf") < 0.2, t + whole(temporal * (0.0000031 * max(0, min(32000, spare))) * t)).otherwise(t))
    return frames.withColumn("target", F.least(t, 2 * F.col("base"))).drop(*(f"_t{k}" for k in range(1, 7)))


def overflows(bits: Column, width: int = 12) -> Column:
    """Whether a length doesn't fit its field."""
    return bits > (1 << width) - 1


def variable_rate_drift(frames: DataFrame, key: str, order: str, target: str, spent: str, boost: str, nominal: int, ceiling: int, lm: int, constrained: bool = True) -> DataFrame:
    """Bytes of variable-rate frames, with the reservoir and the slow drift that hold the nominal rate.

    target, spent and boost are in eighths of a bit.  The drift moves by a gain of
    1 / (frames + 20), and of 1 / 1000 from the 970th on; a debt of the reservoir is
    spent at once.
    """
    most = min(ceiling, 1275 >> (3 - lm))

    def step(state: tuple[int, int, int, int], stream, i: int, want: int, tell: int, more: int) -> tuple[tuple, tuple]:
        reservoir, drift, offset, count = state
        whole = want + tell
        size = min(max((whole + 32) >> 6, ((tell + more + 63) >> 6) + 2), most)
        gain = 0.001
        if count < 970:
            count += 1
            gain = 1.0 / (count + 20)
        if constrained:
            reservoir += (size << 6) - nominal
            drift += int(gain * (whole - nominal - offset - drift))
            offset = -drift
            if reservoir < 0:
                size, reservoir = size + -reservoir // 64, 0
        return (reservoir, drift, offset, count), (stream, i, min(most, size), reservoir, drift)

    rows = frames.select(key, *(F.col(c).cast("long").alias(c) for c in (order, target, spent, boost)))
    kind = frames.schema[key].dataType.simpleString()
    return ordered_fold(rows, key, order, (0, 0, 0, 0), step, f"`{key}` {kind}, `{order}` bigint, bytes bigint, reservoir bigint, drift bigint")


def finest_step(candidates: DataFrame, keys: list[str], step: str, length: str) -> DataFrame:
    """The smallest step; of equal ones the longest frame."""
    return candidates.groupBy(*keys).agg(F.min(F.struct(F.col(step), (-F.col(length)).alias("_l"))).alias("_m")).select(*keys, f"_m.{step}", (-F.col("_m._l")).alias(length))


def within_budget(candidates: DataFrame, keys: list[str], step: str, length: str, budget: Column) -> DataFrame:
    """The finest step whose frame fits; where none fits, the shortest frame; ``fits`` says which."""
    fits = F.col(length) <= budget
    rank = F.struct((~fits).alias("over"), F.when(fits, F.col(step)).otherwise(F.col(length).cast("double")).alias("a"), F.when(fits, -F.col(length)).otherwise(F.lit(0)).alias("b"), F.col(step).alias("step"), F.col(length).alias("length"))
    return candidates.groupBy(*keys).agg(F.min(rank).alias("_m")).select(*keys, F.col("_m.step").alias(step), F.col("_m.length").alias(length), (~F.col("_m.over")).alias("fits"))


def most_active(candidates: DataFrame, keys: list[str], active: str, step: str) -> DataFrame:
    """The candidate of most active scale factors; of equal ones the finest step."""
    return candidates.groupBy(*keys).agg(F.max(F.struct(F.col(active), (-F.col(step)).alias("_s"))).alias("_m")).select(*keys, f"_m.{active}", (-F.col("_m._s")).alias(step))


def least_distorted(candidates: DataFrame, keys: list[str], distortion: str, complexity: str, choice: str, tie: float = 1e-9) -> DataFrame:
    """The candidate of least distortion; of those within ``tie`` of it, the simplest, then the first."""
    from pyspark.sql import Window

    low = F.min(distortion).over(Window.partitionBy(*keys))
    near = candidates.where(F.col(distortion).isNotNull()).withColumn("_low", low).where(F.col(distortion) <= F.col("_low") + tie)
    return near.groupBy(*keys).agg(F.min(F.struct(complexity, choice)).alias("_m")).select(*keys, f"_m.{choice}", f"_m.{complexity}")
