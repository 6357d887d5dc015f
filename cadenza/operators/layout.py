"""Frames and blocks of signals, field widths, gates and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pcm
from . import scan

#: Field widths of the low and high scale factors by code; fixed values of the format.
WIDTHS = ((0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3))
#: Group sizes and widest fields of the two partitions for low rates; fixed values of the format.
PARTITIONS = (((6, 5, 5, 5), (4, 4, 3, 3)), ((6, 5, 7, 3), (4, 4, 3, 0)))


def frame_count(n: Column, size: int, least: int = 0) -> Column:
    """Frames that hold n samples."""
    return F.greatest(F.ceil(n / size), F.lit(least)).cast("long")


def block_sizes(n: Column, size: int = 4096) -> Column:
    """Sizes of the blocks of n samples: whole ones and what is left."""
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(frame_count(n, size) - 1, F.lit(0))), lambda k: F.least(F.lit(size), n - k * size))
    return F.filter(sizes, lambda s: s > 0)


def interleaved(left: Column, right: Column) -> Column:
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b)))


def channel(samples: Column, channels: int, k: int) -> Column:
    """One channel of interleaved samples."""
    return F.filter(samples, lambda _, i: i % channels == k)


def width_code(factors: Column, low: int, widths: Sequence[tuple[int, int]] = WIDTHS) -> Column:
    """The first pair of field widths that holds the first ``low`` factors and the others; null where none does."""
    a = pcm.bit_length(F.coalesce(F.array_max(F.slice(factors, 1, low)), F.lit(0)))
    b = pcm.bit_length(F.coalesce(F.array_max(F.slice(factors, F.lit(low + 1), F.greatest(F.size(factors) - low, F.lit(0)))), F.lit(0)))
    return F.coalesce(*(F.when((a <= x) & (b <= y), k) for k, (x, y) in enumerate(widths))).cast("long")


def partition_code(factors: Column) -> Column:
    """The cheaper feasible partition for low rates: its code and bits; null where neither holds the factors."""
    found = []
    for k, (groups, caps) in enumerate(PARTITIONS):
        at = [sum(groups[:g]) for g in range(4)]
        w = [pcm.bit_length(F.array_max(F.slice(factors, a + 1, n))) for a, n in zip(at, groups, strict=True)]
        fits = (w[0] <= caps[0]) & (w[1] <= caps[1]) & (w[2] <= caps[2]) & (w[3] <= caps[3])
        bits = sum((n * x for n, x in zip(groups[1:], w[1:], strict=True)), groups[0] * w[0])
        head = w[0] * 5 + w[1]
        code = head * 16 + w[2] * 4 + w[3] if k == 0 else 400 + head * 4 + w[2]
        found.append(F.when(fits, F.struct(bits.alias("bits"), F.lit(k).alias("branch"), code.alias("code"))))
    return F.array_min(F.array_compact(F.array(*found)))


def bounded(quantised: Column, bound: int) -> Column:
    """The values, or null where one is over the bound: the candidate is ruled out."""
    return F.when(~F.exists(quantised, lambda q: F.abs(q) > bound), quantised)


def reservoir_pieces(frames: DataFrame, key: str, order: str, slot: str, begin: str, used: str, parts: int | None = None) -> DataFrame:
    """Where the payload of every frame lies: pieces of (frame, slot, offset in the payload, offset in the slot, length).

    Slots of a stream lie end to end, and a frame's payload begins ``begin`` bytes before
    its own slot.  Both are cut where either begins or ends: borders are sorted together,
    and each knows the last slot and the last payload that began, so no pair is formed
    that does not overlap.  Payloads of a stream don't overlap, as a reservoir gives none
    out twice; bytes of a slot that no payload fills have no piece.  ``parts`` (see
    ``scan.parts_for``) deals the streams so that the sorts of a task stay small.
    """
    frames = scan.dealt_by(frames, parts, key) if parts else frames
    so_far = Window.partitionBy(key).orderBy(order)
    placed = frames.withColumn("_at", F.sum(slot).over(so_far) - F.col(slot)).withColumn("_from", F.col("_at") - F.col(begin))
    none = F.lit(None).cast("long")
    border = lambda place, rank, slot_of, slot_at, frame, start: F.struct(place.alias("place"), F.lit(rank).alias("rank"), slot_of.cast("long").alias("slot"), slot_at.cast("long").alias("slot_at"), frame.cast("long").alias("frame"), start.cast("long").alias("start"))
    own, first = F.col(order), F.col("_from")
    # At one place a payload ends before the next begins.
    cuts = F.array(
        border(F.col("_at").cast("long"), 0, own, F.col("_at"), none, none),
        border((first + F.col(used)).cast("long"), 1, none, none, F.lit(-1), none),
        border(first.cast("long"), 2, none, none, own, first),
    )
    held = F.when(F.col(used) > 0, cuts).otherwise(F.slice(cuts, 1, 1))
    borders = placed.select(key, F.explode(held).alias("b")).select(key, "b.*")
    walk = Window.partitionBy(key).orderBy("place", "rank", "slot")
    last = walk.rowsBetween(Window.unboundedPreceding, 0)
    seen = borders.select(key, "place", F.lead("place").over(walk).alias("until"), *(F.last(c, ignorenulls=True).over(last).alias(c) for c in ("slot", "slot_at", "frame")), F.last("start", ignorenulls=True).over(last).alias("start"))
    pieces = seen.where((F.col("until") > F.col("place")) & (F.col("frame") >= 0))
    return pieces.select(key, F.col("frame").alias(order), "slot", (F.col("place") - F.col("start")).alias("payload_offset"), (F.col("place") - F.col("slot_at")).alias("slot_offset"), (F.col("until") - F.col("place")).alias("length"))
