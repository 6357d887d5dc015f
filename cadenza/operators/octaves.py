"""Octave errors of pitch lags, with the last frame's period and gain as carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pcm
from .fold import ordered_fold

#: The multiple of a k-th of the lag that is looked at beside it, for k from 3; fixed values of the codec.
SECOND = (3, 2, 3, 2, 5, 2, 3, 2, 3, 2, 5, 2, 3, 2)


def candidates(x: Column, lag: Column, longest: int, shortest: int, n: int) -> Column:
    """What the fold decides on, for samples of half rate: gain of the lag and its k-ths, each with gain, share and refined lag.

    ``x`` holds half of ``longest`` samples of history and half of ``n`` of the frame; ``lag``,
    ``longest``, ``shortest`` and ``n`` are in samples of the full rate.  Correlations with all
    lags are computed once, and every candidate reads them; none of it depends on the state.
    """
    head, least, size = longest // 2, shortest // 2, n // 2

    def at(k: Column) -> Column:
        return F.slice(x, head + 1 - k, F.lit(size))

    products = pcm.each(head + 1, lambda k: pcm.dot(F.slice(x, head + 1, size), at(k)))
    energies = pcm.each(head + 1, lambda k: pcm.let(at(k), lambda y: pcm.dot(y, y)))

    def found(s: Column) -> Column:
        xy = lambda k: F.coalesce(F.when(k >= 0, F.get(s["xy"], k)), F.lit(0.0))
        gain = lambda c, e: c / F.sqrt(1 + F.get(s["yy"], 0) * e)

        def of(k: Column, t: Column, c: Column, e: Column) -> Column:
            up, mid, down = xy(t + 1), xy(t), xy(t - 1)
            shift = F.when(up - down > 0.7 * (mid - down), 1).when(down - up > 0.7 * (mid - up), -1).otherwise(0)
            share = F.when(e <= F.greatest(c, F.lit(0.0)), 1.0).otherwise(F.greatest(c, F.lit(0.0)) / (e + 1))
            return F.struct(k.cast("long").alias("k"), t.cast("long").alias("t"), gain(c, e).alias("g"), share.alias("share"), F.greatest(2 * t + shift, F.lit(shortest)).cast("long").alias("lag"))

        def part(k: Column) -> Column:
            def beside(t: Column) -> Column:
                double = F.when(s["t"] + t > head, s["t"]).otherwise(s["t"] + t)
                other = F.when(k == 2, double).otherwise(F.floor((2 * F.get(F.lit(list(SECOND)), k - 3) * s["t"] + k) / (2 * k)).cast("int"))
                return pcm.let(other, lambda b: of(k, t, 0.5 * (xy(t) + xy(b)), 0.5 * (F.get(s["yy"], t) + F.get(s["yy"], b))))

            return pcm.let(F.floor((2 * s["t"] + k) / (2 * k)).cast("int"), beside)

        first = of(F.lit(1), s["t"], xy(s["t"]), F.get(s["yy"], s["t"]))
        parts = F.transform(F.sequence(F.lit(2), F.lit(15)), part)
        return F.concat(F.array(first), F.filter(parts, lambda c: c["t"] >= least))

    start = F.least(F.floor(lag / 2).cast("int"), F.lit(head - 1))
    made = pcm.let(F.struct(products.alias("xy"), energies.alias("yy"), start.alias("t")), found)
    return F.when(x.isNotNull() & lag.isNotNull(), made)


def _step(shortest: int):
    least = shortest // 2

    def step(state: tuple[int, float], key, order, found):
        period, gain = state[0] // 2, state[1]
        if not found:
            return state, (key, order, None, None)
        first = best = found[0]
        for c in found[1:]:
            off = abs(c["t"] - period)
            carried = gain if off <= 1 else 0.5 * gain if off <= 2 and 5 * c["k"] ** 2 < first["t"] else 0.0
            bound = max(0.85 * first["g"] - carried, 0.4) if c["t"] < 3 * least else max(0.7 * first["g"] - carried, 0.3)
            if c["g"] > bound:
                best = c
        made = min(best["share"], best["g"])
        return (best["lag"], made), (key, order, best["lag"], made)

    return step


def corrected(df: DataFrame, key: str, order: str, found: str, shortest: int) -> DataFrame:
    """key, order, ``lag`` and ``gain``: the last k-th of the lag that is strong enough, easier near the last frame's lag.

    The fold carries two numbers and reads fifteen short structs a frame; a stream's frames
    stay in order and stream through one task.  A null leaves the state as it is.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(key, order, found)
    return ordered_fold(rows, key, order, (0, 0.0), _step(shortest), f"`{key}` {types[key]}, `{order}` {types[order]}, lag long, gain double")
