"""Dynamic allocation: what bands stand out of their neighbourhood, and the bits that they get for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import pcm

#: Borders of bands in lines of the shortest frame, logarithms of their widths in eighths, and mean log energies; fixed values of the codec.
EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100)
LOG_WIDTHS = (0, 0, 0, 0, 0, 0, 0, 0, 8, 8, 8, 8, 16, 16, 16, 21, 21, 24, 29, 34, 36)
MEANS = (6.4375, 6.25, 5.75, 5.3125, 5.0625, 4.8125, 4.5, 4.375, 4.875, 4.6875, 4.5625, 4.4375, 4.875, 4.625, 4.3125, 4.5, 4.375, 4.625, 4.75, 4.4375, 3.75)


def floor_levels(depth: int) -> list[float]:
    """Noise floor of each band for samples of so many bits."""
    return [0.0625 * w + 0.5 + (9 - depth) - m + 0.0062 * (i + 5) ** 2 for i, (w, m) in enumerate(zip(LOG_WIDTHS, MEANS, strict=True))]


def rising(x: Column, slope: float) -> Column:
    """Each value or the one before, as made, plus the slope, whichever is less."""
    start = F.array().cast("array<double>")
    return F.aggregate(x, start, lambda done, v: F.concat(done, F.array(F.least(v, F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1) + slope, v)))))


def _median(x: Column) -> Column:
    return F.get(F.array_sort(x), F.floor(F.size(x) / 2).cast("int"))


def follower(x: Column) -> Column:
    """Envelope below the bands: up by at most 1.5 a band, down by 2 before the last rise of over 0.5, and not more than 1 below the median around."""
    n = len(MEANS)

    def down(s: Column) -> Column:
        turned = F.reverse(F.slice(s["up"], F.lit(1), s["last"] + 1))
        return F.concat(F.reverse(rising(turned, 2.0)), F.slice(s["up"], s["last"] + 2, F.lit(n)))

    last = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.when(F.get(x, i) > F.get(x, i - 1) + 0.5, i))), F.lit(0))

    def near(i: Column) -> Column:
        at = F.when(i < 2, 1).when(i >= n - 2, n - 2).otherwise(i - 1)
        return _median(F.slice(x, at, F.when((i < 2) | (i >= n - 2), 3).otherwise(5)))

    return pcm.let(pcm.let(F.struct(rising(x, 1.5).alias("up"), last.alias("last")), down), lambda f: pcm.each(n, lambda i: F.greatest(F.get(f, i), near(i) - 1.0)))


def spread_weights(above: Column, deepest: Column) -> Column:
    """32 to 1 by how far a band lies under the mask of its neighbours, 2 a band upwards and 3 downwards; ``above``: over the noise floor."""
    # masks are envelopes turned over
    minus = lambda a: F.transform(a, lambda v: -v)
    mask = minus(F.reverse(rising(F.reverse(rising(minus(above), 2.0)), 3.0)))

    def weight(v: Column, m: Column) -> Column:
        depth = v - F.greatest(F.lit(0.0), deepest - 12, m)
        return F.floor(32 / F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(0.5 + depth), F.lit(5)), F.lit(0)))).cast("long")

    return F.zip_with(above, mask, weight)


def boosts(channels: Sequence[Column], scale: int, size: int, depth: int = 24, capped: bool = False) -> Column:
    """depth, total (eighths of bits) and arrays of boost, importance and weight for each band.

    ``channels``: log amplitudes of 21 bands of one or two channels; ``scale``: frames are
    2^scale shortest ones; ``size``: bytes of a frame, of which boosts take no more than two
    thirds if ``capped`` (constant rates, where they are halved too); up to 50 bytes none is made.
    """
    n, width = len(MEANS), [len(channels) * (b - a) << scale for a, b in zip(EDGES, EDGES[1:], strict=False)]
    noise = F.lit(floor_levels(depth))
    over = [F.zip_with(c, noise, lambda v, f: v - f) for c in channels]
    above = over[0] if len(over) == 1 else F.zip_with(*over, lambda a, b: F.greatest(a, b))

    def told(excess: Column) -> Column:
        return F.transform(excess, lambda v: F.floor(0.5 + 13 * F.pow(F.lit(2.0), F.least(v, F.lit(4.0)))).cast("long"))

    def excess() -> Column:
        lows = [F.zip_with(follower(c), noise, lambda v, f: F.greatest(v, f)) for c in channels]
        if len(channels) == 1:
            return F.zip_with(channels[0], lows[0], lambda v, f: F.greatest(F.lit(0.0), v - f))
        # a channel hears the other 4 below; the first hears the second as raised by itself
        second = F.zip_with(lows[1], lows[0], lambda b, a: F.greatest(b, a - 4.0))
        first = F.zip_with(lows[0], second, lambda a, b: F.greatest(a, b - 4.0))
        sides = [F.zip_with(c, f, lambda v, w: F.greatest(F.lit(0.0), v - w)) for c, f in zip(channels, (first, second), strict=True)]
        return F.zip_with(*sides, lambda a, b: 0.5 * (a + b))

    def shaped(v: Column, i: Column) -> Column:
        return F.least(v * (0.5 if capped else 1.0) * F.when(i < 8, 2.0).when(i >= 12, 0.5).otherwise(1.0), F.lit(4.0))

    def bits(v: Column, i: Column) -> Column:
        w = F.get(F.lit(width), i)
        narrow, wide = F.floor(v), F.floor(v * 8)
        middle = F.floor(v * w / 6)
        boost = F.when(w < 6, narrow).when(w > 48, wide).otherwise(middle)
        cost = F.when(w < 6, narrow * w * 8).when(w > 48, wide * w).otherwise(middle * 48)
        return F.struct(boost.cast("long").alias("boost"), cost.cast("long").alias("cost"))

    cap = 2 * size // 3 << 6

    def spent(asked: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(False).alias("full"), F.array().cast("array<bigint>").alias("boost"))

        def take(s: Column, b: Column) -> Column:
            burst = (F.shiftright(s["total"] + b["cost"], 6) > 2 * size // 3) if capped else F.lit(False)
            given = F.when(s["full"], 0).when(burst, cap - s["total"]).otherwise(b["boost"])
            total = F.when(s["full"], s["total"]).when(burst, cap).otherwise(s["total"] + b["cost"])
            return F.struct(total.cast("long").alias("total"), (s["full"] | burst).alias("full"), F.concat(s["boost"], F.array(given.cast("long"))).alias("boost"))

        return F.aggregate(asked, start, take)

    def all_of(s: Column) -> Column:
        deepest = F.greatest(F.lit(-31.9), F.array_max(s["above"]))
        if size <= 50 or scale < 1:
            flat = lambda v: F.array_repeat(F.lit(v).cast("long"), n)
            return F.struct(deepest.alias("depth"), F.lit(0).cast("long").alias("total"), flat(0).alias("boost"), flat(13).alias("importance"), spread_weights(s["above"], deepest).alias("weight"))
        given = pcm.let(F.transform(F.transform(s["excess"], shaped), bits), spent)
        return pcm.let(given, lambda g: F.struct(deepest.alias("depth"), g["total"].alias("total"), g["boost"].alias("boost"), told(s["excess"]).alias("importance"), spread_weights(s["above"], deepest).alias("weight")))

    return pcm.let(F.struct(above.alias("above"), excess().alias("excess")), all_of)
