"""Hearing models, transients, block schedules and stereo."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hearing as H
from ..functions import pcm
from ..functions import transforms as T
from ..operators import blocks as B
from ..operators.lowdelay import separate
from ..sources.adaptors import event_signal, pcm_blocks, stereo_blocks
from .quality import _r
from .registry import EVENT_SIGNAL, PX, STEREO, query, rounded
from .spectra import _lines

RATE = 44100.0
BINS = 33
HZ = f"(k * {RATE}::DOUBLE / 64)"
_SPECTRUM = f"""{PX}, kk AS (SELECT unnest(range(33)) AS k), dd AS (SELECT block, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * k * i / 64)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * k * i / 64)) AS im FROM px CROSS JOIN kk GROUP BY block, k),
sp AS (SELECT block, k, re * re + im * im AS p FROM dd)"""
_BARK = "(13 * atan(0.00076 * {0}) + 3.5 * atan(pow({0} / 7500, 2)))"
_TONE = f"""{_SPECTRUM}, tn AS (SELECT block, greatest(least(10 * (avg(ln(greatest(p, 1e-12))) / ln(10) - log10(avg(greatest(p, 1e-12)))) / -60, 1.0::DOUBLE), 0.0::DOUBLE) AS t FROM sp GROUP BY block)"""
_MASK = f"""{_TONE}, zz AS (SELECT k, {_BARK.format(HZ)} AS z FROM kk),
mk AS (SELECT s.block, a.k, sum(s.p * pow(10, (15.81 + 7.5 * (a.z - b.z + 0.474) - 17.5 * sqrt(1 + pow(a.z - b.z + 0.474, 2))) / 10)) AS spread FROM sp s JOIN zz b ON b.k = s.k CROSS JOIN zz a GROUP BY s.block, a.k),
th AS (SELECT mk.block, mk.k, spread * pow(10, -(t * 18 + (1 - t) * 6) / 10) AS thr FROM mk JOIN tn USING (block))"""


def _spectrum(spark, sf_dir):
    return pcm_blocks(spark, sf_dir).select("block", T.power_spectrum(F.col("samples"), 64, T.hann_window(64)).alias("power"))


def _masked(spark, sf_dir):
    spectrum = _spectrum(spark, sf_dir).withColumn("tonality", H.flatness_tonality(F.col("power")))
    return spectrum.withColumn("threshold", H.masking_threshold(F.col("power"), H.spread_matrix(BINS, RATE), F.col("tonality")))


@query(f"SELECT k::BIGINT AS bin, {rounded(_BARK.format(HZ))} AS bark, {rounded(f'3.64 * pow(greatest({HZ}, 20) / 1000, -0.8) - 6.5 * exp(-0.6 * pow(greatest({HZ}, 20) / 1000 - 3.3, 2)) + 0.001 * pow(greatest({HZ}, 20) / 1000, 4)')} AS quiet_db FROM (SELECT unnest(range(33)) AS k)")
def hearing_scale(spark, sf_dir):
    """Bark and threshold in quiet of the bins of a 64-point transform."""
    hz = F.col("id") * (RATE / 64)
    return spark.range(BINS).select(F.col("id").alias("bin"), _r(H.bark(hz)).alias("bark"), _r(H.threshold_in_quiet(hz)).alias("quiet_db"))


@query(f"WITH {_TONE} SELECT block, {rounded('t')} AS tonality FROM tn")
def tonality(spark, sf_dir):
    return _spectrum(spark, sf_dir).select("block", _r(H.flatness_tonality(F.col("power"))).alias("tonality"))


@query(f"""WITH {_SPECTRUM}, w AS (SELECT a.block, a.k, avg(ln(greatest(b.p, 1e-12))) / ln(10) AS g, log10(avg(greatest(b.p, 1e-12))) AS m FROM sp a JOIN sp b ON b.block = a.block AND b.k BETWEEN a.k - 8 AND a.k + 8 GROUP BY a.block, a.k)
SELECT block, k::BIGINT AS bin, {rounded('greatest(least(10 * (g - m) / -60, 1.0::DOUBLE), 0.0::DOUBLE)')} AS tonality FROM w""")
def windowed_tonality(spark, sf_dir):
    """Flatness over the 17 bins around each, fewer at the edges."""
    first = lambda k: F.greatest(k - 8, F.lit(0))
    around = lambda p: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: H.flatness_tonality(F.slice(p, first(k) + 1, F.least(k + 9, F.lit(BINS)) - first(k))))
    return _lines(_spectrum(spark, sf_dir), "block", pcm.let(F.col("power"), around), "bin", "tonality")


@query(f"WITH {_MASK} SELECT block, k::BIGINT AS bin, {rounded('thr')} AS threshold FROM th")
def masking_threshold(spark, sf_dir):
    """Power that the bins of a block mask, by bin."""
    return _lines(_masked(spark, sf_dir), "block", F.col("threshold"), "bin", "threshold")


@query(f"WITH {_MASK} SELECT sp.block, {rounded('sum(CASE WHEN p > 0 AND thr > 0 THEN log2(2 * round(sqrt(p / thr)) + 1) ELSE 0 END)')} AS entropy FROM sp JOIN th USING (block, k) GROUP BY sp.block")
def perceptual_entropy(spark, sf_dir):
    return _masked(spark, sf_dir).select("block", _r(H.perceptual_entropy(F.col("power"), F.col("threshold"))).alias("entropy"))


_BANDS = ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32))
_BAND_SQL = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(_BANDS))


@query(f"""WITH {_MASK}, bd(band, lo, hi) AS (VALUES {_BAND_SQL}), l AS (SELECT unnest(range(32)) AS line),
m AS (SELECT block, line, sum(x * sin(pi() / 64 * (i + 0.5)) * cos(pi() / 32 * (i + 0.5 + 16) * (line + 0.5))) AS c FROM px CROSS JOIN l GROUP BY block, line),
e AS (SELECT block, band, sum(c * c) AS e FROM m JOIN bd ON line >= lo AND line < hi GROUP BY block, band),
f AS (SELECT block, band, sum(thr) AS t, sum(p) AS s FROM sp JOIN th USING (block, k) JOIN bd ON k >= lo AND k < hi GROUP BY block, band)
SELECT block, band::BIGINT AS band, {rounded('CASE WHEN e <= 0 THEN 1e-12 WHEN s <= 0 THEN NULL ELSE t / s * e END')} AS allowed FROM e JOIN f USING (block, band)""")
def allowed_noise(spark, sf_dir):
    """Noise that each band of lines may hold: its energy by the ratio of masked to own power of the bins."""
    lines = _masked(spark, sf_dir).join(pcm_blocks(spark, sf_dir).select("block", T.mdct(F.col("samples"), 32, T.sine_window(64)).alias("lines")), "block")
    noise = F.array(*(B.allowed_noise(F.slice("lines", a + 1, b - a), F.slice("power", a + 1, b - a), F.slice("threshold", a + 1, b - a)) for a, b in _BANDS))
    return _lines(lines, "block", noise, "band", "allowed")


@query(f"""WITH {PX}, e AS (SELECT block, i * 8 // 64 AS s, sum(x * x) AS e FROM px GROUP BY block, s), r AS (SELECT block, s, e, avg(e) OVER (PARTITION BY block ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e)
SELECT block, {rounded('greatest(max(CASE WHEN m > 1e-12 THEN e / m END), 1.0::DOUBLE)')} AS attack, coalesce(max(CASE WHEN m > 1e-12 THEN e / m END), 1) >= 2.5 AS transient FROM r GROUP BY block""")
def attack_ratio(spark, sf_dir):
    """Largest ratio of a segment's energy to the mean of those before, and whether it is a transient (from 2.5 here)."""
    found = pcm_blocks(spark, sf_dir).withColumn("attack", B.attack_ratio(B.segment_energies(F.col("samples"), 64, 8)))
    return found.select("block", _r("attack").alias("attack"), (F.col("attack") >= 2.5).alias("transient"))


@query(f"""WITH {PX}, e AS (SELECT block, i // 5 AS s, sum(x * x) AS e FROM px WHERE i < 60 GROUP BY block, s), t AS (SELECT block, max(e.e) AS top FROM e GROUP BY block),
r AS (SELECT e.block, e.e, top, lag(e.e) OVER (PARTITION BY e.block ORDER BY s) AS before FROM e JOIN t USING (block))
SELECT block, coalesce(bool_or(e > 8 * greatest(before, top * 0.001) AND e > 0.05 * top), false) AS transient FROM r WHERE before IS NOT NULL GROUP BY block""")
def granule_transient(spark, sf_dir):
    """Twelve chunks: one over 8 times that before it, with a floor, and over 5 % of the peak."""
    return pcm_blocks(spark, sf_dir).select("block", B.granule_transient(B.segment_sums(F.col("samples"), 5, 12)).alias("transient"))


_FLAGS = f"{EVENT_SIGNAL}, fl AS (SELECT user_id, i, x > 0.6 AS t FROM ev)"


@query(f"""WITH {_FLAGS}, a AS (SELECT user_id, i, t OR (coalesce(lag(t) OVER w, false) AND coalesce(lead(t) OVER w, false)) AS s FROM fl WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, CASE WHEN s THEN 'short' WHEN coalesce(lead(s) OVER w, false) THEN 'start' WHEN coalesce(lag(s) OVER w, false) THEN 'stop' ELSE 'long' END AS block_type FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def block_schedule(spark, sf_dir):
    """Long, start, short and stop blocks around the transients of each user's signal."""
    flags = event_signal(spark, sf_dir).select("user_id", "i", (F.col("x") > 0.6).alias("transient"))
    return B.block_schedule(flags, "user_id", "i", "transient").select("user_id", "i", "block_type")


@query(f"""WITH {_FLAGS}, g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, t ORDER BY i) AS island FROM fl)
SELECT user_id, min(i)::BIGINT AS first, count(*)::BIGINT AS frames, (CASE WHEN t THEN 8 * count(*) ELSE count(*) END)::BIGINT AS blocks, t AS short FROM g GROUP BY user_id, t, island""")
def short_runs(spark, sf_dir):
    """Runs of equal flags; a run of transient frames becomes eight short blocks a frame."""
    flags = event_signal(spark, sf_dir).select("user_id", "i", (F.col("x") > 0.6).alias("short"))
    return B.short_runs(flags, "user_id", "i", "short")


@query(f"""WITH {STEREO}, m AS (SELECT pair, sum(pow((l + r) / sqrt(2), 2)) AS m, sum(pow((l - r) / sqrt(2), 2)) AS s FROM st GROUP BY pair)
SELECT pair, {rounded('s / (m + s)')} AS side_fraction, s / (m + s) < 0.45 AS use_ms FROM m""")
def side_energy(spark, sf_dir):
    """Share of the side in the energy of orthonormal mid and side, and whether it is low enough for mid/side coding (0.45 here)."""
    f = B.side_fraction(F.col("left"), F.col("right"))
    return stereo_blocks(spark, sf_dir).select("pair", f.alias("f")).select("pair", _r("f").alias("side_fraction"), (F.col("f") < 0.45).alias("use_ms"))


@query(f"""WITH {STEREO}, q AS (SELECT pair, i, round(l * 32767)::BIGINT AS l, round(r * 32767)::BIGINT AS r FROM st)
SELECT pair, sum((l + r) >> 1)::BIGINT AS mid_sum, sum(abs((l + r) >> 1))::BIGINT AS mid_abs, sum(l - r)::BIGINT AS side_sum, sum(abs(l - r))::BIGINT AS side_abs FROM q GROUP BY pair""")
def integer_mid_side(spark, sf_dir):
    """Sums of integer mid, which floors, and side."""
    q = stereo_blocks(spark, sf_dir).select("pair", F.zip_with(F.transform("left", lambda x: pcm.quantise(x, 16)), F.transform("right", lambda x: pcm.quantise(x, 16)), lambda a, b: F.struct(F.shiftright(a + b, 1).alias("m"), (a - b).alias("s"))).alias("ms"))
    add = lambda f: F.aggregate("ms", F.lit(0).cast("long"), lambda t, x: t + f(x))
    return q.select("pair", add(lambda x: x["m"]).alias("mid_sum"), add(lambda x: F.abs(x["m"])).alias("mid_abs"), add(lambda x: x["s"]).alias("side_sum"), add(lambda x: F.abs(x["s"])).alias("side_abs"))


@query(f"""WITH {STEREO}, c AS (SELECT pair, i, CASE WHEN abs(l) > abs(r) THEN l ELSE r END AS mag, CASE WHEN abs(l) > abs(r) THEN (CASE WHEN l > 0 THEN l - r ELSE r - l END) ELSE (CASE WHEN r > 0 THEN l - r ELSE r - l END) END AS ang FROM st)
SELECT pair, {rounded('sum(abs(mag))')} AS magnitude, {rounded('sum(abs(ang))')} AS angle FROM c GROUP BY pair""")
def square_polar(spark, sf_dir):
    """Sums of the magnitudes and angles of square-polar coupling."""
    pairs = F.zip_with("left", "right", B.square_polar)
    found = stereo_blocks(spark, sf_dir).select("pair", pairs.alias("c"))
    return found.select("pair", _r(pcm.total(F.col("c"), lambda c: F.abs(c["magnitude"]))).alias("magnitude"), _r(pcm.total(F.col("c"), lambda c: F.abs(c["angle"]))).alias("angle"))


@query(f"""WITH {STEREO}, s AS (SELECT pair, sum(abs(l)) AS al, sum(abs(r)) AS ar, sum(abs(l + r)) AS am, sum(abs(l - r)) AS a_s FROM st GROUP BY pair)
SELECT pair, {rounded('(al + ar) / ((am + a_s) * sqrt(0.5))')} AS ratio, 133 * (am + a_s + 1e-15) * sqrt(0.5) > 128 * (al + ar + 1e-15) AS dual FROM s""")
def dual_stereo(spark, sf_dir):
    """Whether left and right cost less than mid and side, by sums of magnitudes and what the angles cost."""
    one = lambda f: pcm.total(F.zip_with("left", "right", f), F.abs)
    s = stereo_blocks(spark, sf_dir).select("pair", (one(lambda a, b: a) + one(lambda a, b: b)).alias("lr"), ((one(lambda a, b: a + b) + one(lambda a, b: a - b)) * (0.5**0.5)).alias("ms"), separate(F.col("left"), F.col("right"), 128, small=True).alias("dual"))
    return s.select("pair", _r(F.col("lr") / F.col("ms")).alias("ratio"), "dual")


@query(f"""WITH {EVENT_SIGNAL} SELECT user_id, {rounded('sqrt(avg(x * x))')} AS rms, count(*)::BIGINT AS n, (count(*) = count(CASE WHEN x = 0 THEN 1 END)) AS silent FROM ev GROUP BY user_id""")
def signal_level(spark, sf_dir):
    """RMS of each user's signal, and whether it is silent."""
    return event_signal(spark, sf_dir).groupBy("user_id").agg(_r(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"), F.count("*").alias("n"), F.bool_and(F.col("x") == 0).alias("silent"))
