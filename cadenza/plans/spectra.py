"""Windows, transforms, lags and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pcm
from ..functions import transforms as T
from ..operators import spectra
from ..sources.adaptors import event_signal, pcm_blocks, stereo_blocks
from .quality import _r
from .registry import EVENT_SIGNAL, PX, STEREO, query, rounded


def _lines(df, key, values, name="line", out="value"):
    """Long form of an array, rounded."""
    long = df.select(key, F.posexplode(values).alias(name, out))
    return long.select(key, F.col(name).cast("long").alias(name), _r(out).alias(out))


def _mdct_sql(window: str, scale: str = "1.0") -> str:
    return f"""WITH {PX}, k AS (SELECT unnest(range(32)) AS k)
SELECT block, k.k::BIGINT AS line, {rounded(f'{scale} * sum(x * {window} * cos(pi() / 32 * (i + 0.5 + 16) * (k.k + 0.5)))')} AS value FROM px CROSS JOIN k GROUP BY block, k.k"""


@query(_mdct_sql("sin(pi() / 64 * (i + 0.5))"))
def mdct_sine(spark, sf_dir):
    """Unnormalised MDCT of 64 samples to 32 lines under the sine window."""
    return _lines(pcm_blocks(spark, sf_dir), "block", T.mdct(F.col("samples"), 32, T.sine_window(64)))


@query(_mdct_sql("sin(pi() / 2 * pow(sin(pi() / 64 * (i + 0.5)), 2))", "(4.0 / 64)"))
def mdct_power_sine(spark, sf_dir):
    """MDCT scaled by 4 over the frame's samples, under the power-sine window."""
    return _lines(pcm_blocks(spark, sf_dir), "block", T.mdct(F.col("samples"), 32, T.power_sine_window(64), 4.0 / 64))


@query(f"""WITH {PX}, k AS (SELECT unnest(range(32)) AS k),
m AS (SELECT block, k.k, sum(x * sin(pi() / 64 * (i + 0.5)) * cos(pi() / 32 * (i + 0.5 + 16) * (k.k + 0.5))) AS c FROM px CROSS JOIN k GROUP BY block, k.k),
n AS (SELECT unnest(range(64)) AS n)
SELECT block, n.n::BIGINT AS i, {rounded('sum(c * cos(pi() / 32 * (n.n + 0.5 + 16) * (m.k + 0.5)))')} AS value FROM m CROSS JOIN n GROUP BY block, n.n""")
def imdct_aliased(spark, sf_dir):
    """The inverse of the sine-window MDCT before overlap and addition."""
    lines = pcm_blocks(spark, sf_dir).withColumn("lines", T.mdct(F.col("samples"), 32, T.sine_window(64)))
    return _lines(lines, "block", T.imdct(F.col("lines"), 32), "i")


@query(f"""WITH {PX}, f AS (SELECT a.stream_id, a.block, a.block * 2 + h.h AS frame, 32 * h.h + n.n AS at FROM (SELECT DISTINCT stream_id, block FROM px) a CROSS JOIN (SELECT unnest(range(2)) AS h) h CROSS JOIN (SELECT unnest(range(64)) AS n) n),
g AS (SELECT f.block, f.frame - f.block * 2 AS frame, f.at - 32 * (f.frame - f.block * 2) AS n, coalesce(px.x, 0.0) * sin(pi() / 64 * (f.at - 32 * (f.frame - f.block * 2) + 0.5)) AS x FROM f LEFT JOIN px ON px.block = f.block AND px.i = f.at),
k AS (SELECT unnest(range(32)) AS k), m AS (SELECT block, frame, k.k, sum(x * cos(pi() / 32 * (n + 0.5 + 16) * (k.k + 0.5))) AS c FROM g CROSS JOIN k GROUP BY block, frame, k.k),
y AS (SELECT block, frame * 32 + n.n AS i, sum(c * cos(pi() / 32 * (n.n + 0.5 + 16) * (m.k + 0.5))) * sin(pi() / 64 * (n.n + 0.5)) / 32 AS y FROM m CROSS JOIN (SELECT unnest(range(64)) AS n) n GROUP BY block, frame, n.n)
SELECT block, i::BIGINT AS i, {rounded('sum(y)')} AS value FROM y WHERE i BETWEEN 32 AND 63 GROUP BY block, i""")
def mdct_overlap_add(spark, sf_dir):
    """Two frames at a hop of 32, transformed, inverted, windowed and added: samples 32 to 63 come back."""
    window = T.sine_window(64)
    framed = spectra.frames(pcm_blocks(spark, sf_dir).select("block", "samples").withColumnRenamed("block", "id"), "samples", 64, 32)
    lines = spectra.transform(framed, "block", spectra.mdct_matrix(32, window), "lines")
    back = lines.select("id", "frame", T.windowed(T.imdct(F.col("lines"), 32, 1 / 32), window).alias("part"))
    added = spectra.overlap_add(back, "id", "frame", "part", 32)
    return added.where("i between 32 and 63").select(F.col("id").alias("block"), F.col("i").cast("long").alias("i"), _r("value").alias("value"))


@query(f"""WITH {PX}, k AS (SELECT unnest(range(33)) AS k), d AS (SELECT block, k.k, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * k.k * i / 64)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * k.k * i / 64)) AS im FROM px CROSS JOIN k GROUP BY block, k.k)
SELECT block, k::BIGINT AS bin, {rounded('re * re + im * im')} AS power FROM d""")
def power_spectrum(spark, sf_dir):
    """33 bins of the DFT under the periodic Hann window."""
    return _lines(pcm_blocks(spark, sf_dir), "block", T.power_spectrum(F.col("samples"), 64, T.hann_window(64)), "bin", "power")


@query(f"""WITH {PX}, p AS (SELECT a.block, a.i // 2 AS k, a.x AS x, b.x AS y FROM px a JOIN px b ON b.block = a.block AND b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT block, (2 * k)::BIGINT AS i, {rounded('(x + y) * sqrt(0.5)')} AS value FROM p UNION ALL SELECT block, (2 * k + 1)::BIGINT, {rounded('(x - y) * sqrt(0.5)')} FROM p""")
def haar_butterfly(spark, sf_dir):
    return _lines(pcm_blocks(spark, sf_dir), "block", T.haar(F.col("samples")), "i")


@query(f"""WITH {EVENT_SIGNAL} SELECT user_id, i, {rounded('x - 0.85 * coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY i), 0.0)')} AS value FROM ev""")
def pre_emphasis(spark, sf_dir):
    """First-order high-pass of each user's signal."""
    from pyspark.sql import Window

    before = F.lag("x", 1, 0.0).over(Window.partitionBy("user_id").orderBy("i"))
    return event_signal(spark, sf_dir).select("user_id", "i", _r(F.col("x") - 0.85 * before).alias("value"))


@query(f"""WITH {EVENT_SIGNAL}, w AS (SELECT user_id, i, x, lag(x, 1, 0) OVER o AS a, lag(x, 2, 0) OVER o AS b, lag(x, 3, 0) OVER o AS c, lag(x, 4, 0) OVER o AS d, lag(x, 5, 0) OVER o AS e FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, {rounded('x + 0.5 * a - 0.25 * b + 0.125 * c - 0.0625 * d + 0.03125 * e', 9)} AS value FROM w""")
def fir_five(spark, sf_dir):
    """Five-tap filter over the samples before."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("i")
    taps = (0.5, -0.25, 0.125, -0.0625, 0.03125)
    value = F.col("x")
    for k, tap in enumerate(taps, 1):
        value = value + tap * F.lag("x", k, 0.0).over(order)
    return event_signal(spark, sf_dir).select("user_id", "i", _r(value, 9).alias("value"))


@query(f"""WITH {PX}, k AS (SELECT unnest(range(16)) AS lag) SELECT a.block, k.lag::BIGINT AS lag, {rounded('sum(a.x * b.x)')} AS value FROM px a CROSS JOIN k JOIN px b ON b.block = a.block AND b.i = a.i + k.lag GROUP BY a.block, k.lag""")
def autocorrelation(spark, sf_dir):
    return _lines(pcm_blocks(spark, sf_dir), "block", spectra.autocorrelation(F.col("samples"), 64, 16), "lag")


@query(f"""WITH {STEREO}, k AS (SELECT unnest(range(24)) AS lag) SELECT a.pair, k.lag::BIGINT AS lag, {rounded('sum(a.l * b.r)')} AS value FROM st a CROSS JOIN k JOIN st b ON b.pair = a.pair AND b.i = a.i + k.lag GROUP BY a.pair, k.lag""")
def cross_correlation(spark, sf_dir):
    """Of left with right at lags 0 to 23, as far as both reach."""
    each = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: pcm.dot(F.slice("left", F.lit(1), 64 - k), F.slice("right", k + 1, 64 - k)))
    return _lines(stereo_blocks(spark, sf_dir), "pair", each, "lag")


@query(f"""WITH {STEREO}, k AS (SELECT unnest(range(24)) AS lag), c AS (SELECT a.pair, k.lag, sum(a.l * b.r) AS xy, sum(b.r * b.r) AS yy FROM st a CROSS JOIN k JOIN st b ON b.pair = a.pair AND b.i = a.i + k.lag GROUP BY a.pair, k.lag),
s AS (SELECT pair, lag, CASE WHEN xy > 0 THEN round(xy * xy / (1 + yy), 9) ELSE -1.0 END AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, lag) AS place FROM s)
SELECT pair, place::BIGINT AS place, lag::BIGINT AS lag, {rounded('score')} AS score FROM r WHERE place <= 2""")
def pitch_candidates(spark, sf_dir):
    """The two lags of the highest normalised positive correlation, earlier first where equal."""

    def score(k):
        right = F.slice("right", k + 1, 64 - k)
        energy = 1 + pcm.dot(right, right)
        found = pcm.let(pcm.dot(F.slice("left", F.lit(1), 64 - k), right), lambda xy: F.when(xy > 0, F.round(xy * xy / energy, 9)).otherwise(-1.0))
        return F.struct(found.alias("score"), (-k).alias("neg"))

    scored = F.transform(F.sequence(F.lit(0), F.lit(23)), score)
    best = F.slice(F.sort_array(scored, asc=False), 1, 2)
    found = stereo_blocks(spark, sf_dir).select("pair", F.posexplode(best).alias("p", "s"))
    return found.select("pair", (F.col("p") + 1).cast("long").alias("place"), (-F.col("s.neg")).cast("long").alias("lag"), _r("s.score").alias("score"))


_LEVINSON = f"""WITH RECURSIVE {PX}, k AS (SELECT unnest(range(5)) AS lag), c AS (SELECT a.block, k.lag, sum(a.x * b.x) AS v FROM px a CROSS JOIN k JOIN px b ON b.block = a.block AND b.i = a.i + k.lag GROUP BY a.block, k.lag),
r AS (SELECT block, list(v ORDER BY lag) AS r FROM c GROUP BY block),
l AS (SELECT block, r, 0 AS i, r[1] AS e, []::DOUBLE[] AS a FROM r
UNION ALL SELECT block, r, i + 1, e * (1 - k * k), list_append([a[j] - k * a[i + 1 - j] FOR j IN range(1, i + 1)], k) FROM (SELECT block, r, i, e, a, (r[i + 2] - coalesce(list_sum([a[j] * r[i + 2 - j] FOR j IN range(1, i + 1)]), 0)) / e AS k FROM l WHERE i < 4)),
o AS (SELECT block, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS j FROM l WHERE i = 4)
SELECT block, j::BIGINT AS tap, {rounded('v')} AS value FROM o"""


@query(_LEVINSON)
def linear_prediction(spark, sf_dir):
    """Four predictor taps of each block."""
    r = pcm_blocks(spark, sf_dir).withColumn("r", spectra.autocorrelation(F.col("samples"), 64, 5))
    return _lines(r, "block", spectra.levinson(F.col("r"), 4), "tap")


@query(f"""WITH {PX}, t AS (SELECT o, i, i - o * 2 / 3.0::DOUBLE AS d FROM (SELECT unnest(range(96)) AS o) CROSS JOIN (SELECT unnest(range(64)) AS i)),
w AS (SELECT o, i, (CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE sin(pi() * d) / (pi() * d) END) * (0.42 + 0.5 * cos(pi() * d / 16) + 0.08 * cos(2 * pi() * d / 16)) AS w FROM t WHERE abs(d) <= 16)
SELECT block, o::BIGINT AS i, {rounded('sum(x * w) / sum(w)')} AS value FROM px JOIN w USING (i) GROUP BY block, o""")
def resample(spark, sf_dir):
    """32 kHz to 48 kHz by a windowed sinc of 16 zero crossings."""
    rows = spectra.resample_taps(32000, 48000, 64)
    taps = F.array(*(F.struct(F.lit(row[0][0] + 1).alias("at"), T.constants([w for _, w in row]).alias("w")) for _, row in rows))
    out = F.transform(taps, lambda t: pcm.dot(F.slice("samples", t["at"], F.size(t["w"])), t["w"]))
    return _lines(pcm_blocks(spark, sf_dir), "block", out, "i")
