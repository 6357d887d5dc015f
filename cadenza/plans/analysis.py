"""Transients, octave errors, dynamic allocation and resampling, over whole streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as T
from ..operators import allocation as A
from ..operators import boosts as B
from ..operators import lowdelay as L
from ..operators import octaves as O
from ..operators import resampling as S
from ..operators import spectra
from ..operators import transients as N
from ..sources.adaptors import clips, pcm_blocks
from . import lowdelay  # noqa: F401 (registers the pitch search, whose SQL is read below)
from .quality import _r
from .registry import CLIPS, ORACLE_SQL, PX, query, rounded


def _metric_sql(row: str, source: str, size: int, decay: float) -> str:
    """High-pass by running sums of the sine and cosine parts of its memory, smoothing by running sums over powers; both from the closed forms of the filters."""
    half = size // 2
    keep = f"{1 - decay}::DOUBLE"
    return f"""rs AS (SELECT {row}, n, sum(x * pow(2, n / 2.0::DOUBLE) * cos(n * pi() / 4)) OVER w AS c, sum(x * pow(2, n / 2.0::DOUBLE) * sin(n * pi() / 4)) OVER w AS s FROM {source} WINDOW w AS (PARTITION BY {row} ORDER BY n)),
rv AS (SELECT {row}, n, pow(2, -n / 2.0::DOUBLE) * ((cos(n * pi() / 4) + sin(n * pi() / 4)) * c + (sin(n * pi() / 4) - cos(n * pi() / 4)) * s) AS v FROM rs),
hy AS (SELECT {row}, n, CASE WHEN n < 12 THEN 0 ELSE v - 2 * lag(v) OVER w + lag(v, 2) OVER w END AS y FROM rv WINDOW w AS (PARTITION BY {row} ORDER BY n)),
pe AS (SELECT {row}, n // 2 AS i, sum(y * y) AS e FROM hy GROUP BY ALL),
pf AS (SELECT {row}, i, e, {decay}::DOUBLE * pow({keep}, i) * sum(e * pow({keep}, -i)) OVER (PARTITION BY {row} ORDER BY i) AS f FROM pe),
pb AS (SELECT {row}, i, e, 0.125::DOUBLE * pow(0.875::DOUBLE, {half - 1} - i) * sum(f * pow(0.875::DOUBLE, i - {half - 1})) OVER (PARTITION BY {row} ORDER BY i DESC) AS m FROM pf),
pn AS (SELECT {row}, {half} / (1e-15::DOUBLE + sqrt(sum(e) * max(m) * 0.5 * {half})) AS norm FROM pb GROUP BY ALL),
mt AS (SELECT {row}, (64 * 4 * sum(({list(N.INVERSE)})[1 + least(floor(64 * norm * (m + 1e-15::DOUBLE)), 127)::BIGINT]) // {6 * (half - 17)})::BIGINT AS metric FROM pb JOIN pn USING ({row.replace(' AS ', ' ')}) WHERE i >= 12 AND i + 5 < {half} AND i % 4 = 0 GROUP BY ALL)"""


_ESTIMATE = rounded("sqrt(greatest(0.0::DOUBLE, 0.0069::DOUBLE * least(163.0::DOUBLE, greatest(0.0::DOUBLE, sqrt(27.0::DOUBLE * metric) - 42)) - 0.139::DOUBLE))")


@query(f"WITH {CLIPS}, {_metric_sql('clip', 'cl', 1152, 0.0625)} SELECT clip, metric, metric > 200 AS transient, {_ESTIMATE} AS estimate FROM mt")
def masked_transients(spark, sf_dir):
    """Whether a clip is louder than what masks it, and how much more it may cost."""
    found = N.transients(clips(spark, sf_dir), ["samples"], "t")
    return found.select("clip", "t.metric", "t.transient", _r("t.estimate").alias("estimate"))


def _paired(df, column):
    """Clips 2k and 2k + 1 as channels: pair, left and right."""
    side = lambda k: F.max(F.when(F.col("clip") % 2 == k, F.col(column)))
    return df.groupBy(F.floor(F.col("clip") / 2).alias("pair")).agg(side(0).alias("left"), side(1).alias("right")).where("left is not null and right is not null")


@query(f"""WITH {CLIPS}, ss AS (SELECT clip // 2 AS pair, clip % 2 AS channel, n, x FROM cl WHERE clip // 2 IN (SELECT clip // 2 FROM cl GROUP BY 1 HAVING count(DISTINCT clip) = 2)), {_metric_sql('pair, channel', 'ss', 1152, 0.03125)},
tp AS (SELECT pair, max(metric) AS metric, arg_min(channel, (-metric, channel))::BIGINT AS channel FROM mt GROUP BY pair)
SELECT pair, metric, channel, metric >= 600 AS transient, metric > 200 AND metric < 600 AS weak, {_ESTIMATE} AS estimate FROM tp""")
def weak_transients(spark, sf_dir):
    """Transients of either channel at low rates, where weak ones go without short blocks."""
    found = N.transients(_paired(clips(spark, sf_dir), "samples"), ["left", "right"], "t", weak=True)
    return found.select("pair", "t.metric", "t.channel", "t.transient", "t.weak", _r("t.estimate").alias("estimate"))


#: Blocks of a stream, for rates.
_LONG = 250


@query(f"""WITH {PX}, sm AS (SELECT block // {_LONG} AS stream, block % {_LONG} * 64 + i AS n, x FROM px), en AS (SELECT stream, max(n) + 1 AS size FROM sm GROUP BY stream),
ou AS (SELECT stream, size, unnest(range((size * 320 + 147) // 294)) AS m FROM en), tp AS (SELECT stream, m, unnest(range(greatest(0, m * 147 // 160 - 16), least(size, m * 147 // 160 + 18))) AS n FROM ou),
w AS (SELECT *, m * 147 / 160.0::DOUBLE - n AS d FROM tp), k AS (SELECT stream, m, n, (CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE sin(pi() * d) / (pi() * d) END) * (0.42 + 0.5 * cos(pi() * d / 16) + 0.08 * cos(pi() * d / 8)) AS k FROM w WHERE abs(d) <= 16)
SELECT stream, m::BIGINT AS i, {rounded('sum(coalesce(x, 0) * k) / sum(k)')} AS value FROM k LEFT JOIN sm USING (stream, n) GROUP BY stream, m""")
def resample_streams(spark, sf_dir):
    """Streams of many blocks from 44.1 to 48 kHz."""
    blocks = pcm_blocks(spark, sf_dir).select(F.floor(F.col("block") / _LONG).alias("stream"), (F.col("block") % _LONG).alias("block"), "samples")
    made = S.resample(blocks, ["stream"], "block", "samples", 64, 44100, 48000)
    long = made.select("stream", "start", F.posexplode("value").alias("k", "v"))
    return long.select("stream", (F.col("start") + F.col("k")).alias("i"), _r("v").alias("value"))


_LAGS = ORACLE_SQL["pitch_search"].removeprefix(f"WITH {PX}, ")
_SECONDS = ", ".join(f"({k}, {v})" for k, v in enumerate(O.SECOND, 3))


@query(f"""WITH RECURSIVE {PX}, pl AS (WITH {_LAGS}), t0 AS (SELECT block, least((64 - lag) // 2, 31) AS t FROM pl),
cr AS (SELECT a.block, k.lag, sum(CASE WHEN a.i >= 32 THEN a.x * b.x END) AS xy, sum(b.x * b.x) AS yy FROM px a CROSS JOIN (SELECT unnest(range(33)) AS lag) k JOIN px b ON b.block = a.block AND b.i = a.i - k.lag WHERE a.i >= 32 GROUP BY a.block, k.lag),
se(k, second) AS (VALUES {_SECONDS}), ks AS (SELECT block, t0.t AS t0, k, (2 * t0.t + k) // (2 * k) AS t, (2 * second * t0.t + k) // (2 * k) AS other FROM t0 CROSS JOIN (SELECT unnest(range(2, 16)) AS k) LEFT JOIN se USING (k)),
ab AS (SELECT block, t0, 1 AS k, t0 AS t, t0 AS other FROM (SELECT block, t AS t0 FROM t0) UNION ALL SELECT block, t0, k, t, CASE WHEN k > 2 THEN other WHEN t + t0 > 32 THEN t0 ELSE t + t0 END FROM ks WHERE t >= 4),
ca AS (SELECT ab.block, ab.t0, ab.k, ab.t, 0.5 * (a.xy + b.xy) AS xy, 0.5 * (a.yy + b.yy) AS yy, z.yy AS xx, coalesce(up.xy, 0) AS up, a.xy AS mid, coalesce(dn.xy, 0) AS dn FROM ab JOIN cr a ON a.block = ab.block AND a.lag = ab.t JOIN cr b ON b.block = ab.block AND b.lag = ab.other JOIN cr z ON z.block = ab.block AND z.lag = 0
LEFT JOIN cr up ON up.block = ab.block AND up.lag = ab.t + 1 LEFT JOIN cr dn ON dn.block = ab.block AND dn.lag = ab.t - 1),
cg AS (SELECT block, t0, k, t, xy / sqrt(1 + xx * yy) AS g, CASE WHEN yy <= greatest(xy, 0) THEN 1 ELSE greatest(xy, 0) / (yy + 1) END AS share, greatest(8, 2 * t + CASE WHEN up - dn > 0.7 * (mid - dn) THEN 1 WHEN dn - up > 0.7 * (mid - up) THEN -1 ELSE 0 END) AS lag FROM ca),
fr AS (SELECT block // 18 AS clip, block, row_number() OVER (PARTITION BY block // 18 ORDER BY block) AS place, any_value(t0) AS t0, max(CASE WHEN k = 1 THEN g END) AS g0, list({{'k': k, 't': t, 'g': g, 'share': share, 'lag': lag}} ORDER BY k) AS cands FROM cg GROUP BY block),
ru AS (SELECT DISTINCT clip, 0::BIGINT AS place, NULL::BIGINT AS block, 0::BIGINT AS lag, 0.0::DOUBLE AS gain FROM fr UNION ALL
SELECT clip, place, block, b.lag::BIGINT, least(b.share, b.g) FROM (SELECT fr.clip, fr.place, fr.block, list_filter(fr.cands, lambda v: v.k = 1 OR v.g > CASE WHEN v.t < 12 THEN greatest(0.4::DOUBLE, 0.85 * g0 - (CASE WHEN abs(v.t - ru.lag // 2) <= 1 THEN ru.gain WHEN abs(v.t - ru.lag // 2) <= 2 AND 5 * v.k * v.k < t0 THEN 0.5 * ru.gain ELSE 0 END))
ELSE greatest(0.3::DOUBLE, 0.7 * g0 - (CASE WHEN abs(v.t - ru.lag // 2) <= 1 THEN ru.gain WHEN abs(v.t - ru.lag // 2) <= 2 AND 5 * v.k * v.k < t0 THEN 0.5 * ru.gain ELSE 0 END)) END)[-1] AS b FROM ru JOIN fr ON fr.clip = ru.clip AND fr.place = ru.place + 1))
SELECT clip, block, lag, {rounded('gain')} AS gain FROM ru WHERE place > 0""")
def octave_errors(spark, sf_dir):
    """Lag and gain of each block of a clip, after the pitch search, with its k-ths tried."""
    lag = 64 - L.pitch(F.slice("samples", 33, 32), F.col("samples"), 32, 32)
    rows = pcm_blocks(spark, sf_dir).select(F.floor(F.col("block") / 18).alias("clip"), "block", O.candidates(F.col("samples"), lag, 64, 8, 64).alias("c"))
    return O.corrected(rows, "clip", "block", "c", 8).select("clip", "block", "lag", _r("gain").alias("gain"))


_BANDS = ", ".join(f"({i}, {a * 8}, {b * 8}, {w}, {m}::DOUBLE)" for i, (a, b, w, m) in enumerate(zip(B.EDGES, B.EDGES[1:], B.LOG_WIDTHS, B.MEANS, strict=False)))
#: The tables hold noise, whose bands are much alike; levels are expanded so that some stand out.
_EXPANDED = 5
#: Log amplitudes of bands in 1024ths, so that differences of equal ones are exact.
_LEVELS = f"""{CLIPS}, bd(band, lo, hi, lw, mean) AS (VALUES {_BANDS}), nf AS (SELECT band, hi - lo AS width, 0.0625 * lw + 0.5 + (9 - 24) - mean + 0.0062 * (band + 5) * (band + 5) AS noise FROM bd),
ml AS (SELECT clip, k, sum(x * sin(pi() / 2048 * (n + 0.5)) * cos(pi() / 1024 * (n + 0.5 + 512) * (k + 0.5))) AS v FROM cl CROSS JOIN (SELECT unnest(range(800)) AS k) GROUP BY clip, k),
lv AS MATERIALIZED (SELECT clip, band, round(({_EXPANDED} * log2(sqrt(1e-27::DOUBLE + sum(v * v))) - any_value(mean)) * 1024) / 1024 AS x FROM ml JOIN bd ON k >= lo AND k < hi GROUP BY clip, band),
up AS (SELECT a.clip, a.band, min(b.x + 1.5 * (a.band - b.band)) AS u FROM lv a JOIN lv b ON b.clip = a.clip AND b.band <= a.band GROUP BY a.clip, a.band),
la AS (SELECT a.clip, coalesce(max(CASE WHEN a.x > b.x + 0.5 THEN a.band END), 0) AS last FROM lv a JOIN lv b ON b.clip = a.clip AND b.band = a.band - 1 GROUP BY a.clip),
dn AS (SELECT a.clip, a.band, min(b.u + 2.0 * (b.band - a.band)) AS d FROM up a JOIN la ON la.clip = a.clip JOIN up b ON b.clip = a.clip AND (b.band = a.band OR (b.band > a.band AND b.band <= last)) GROUP BY a.clip, a.band),
me AS (SELECT a.clip, a.band, median(b.x) AS m FROM lv a JOIN lv b ON b.clip = a.clip AND (CASE WHEN a.band < 2 THEN b.band < 3 WHEN a.band > 18 THEN b.band > 17 ELSE abs(b.band - a.band) <= 2 END) GROUP BY a.clip, a.band),
fo AS MATERIALIZED (SELECT lv.clip, lv.band, lv.x, noise, greatest(d, m - 1.0, noise) AS f FROM lv JOIN dn USING (clip, band) JOIN me USING (clip, band) JOIN nf USING (band))"""


def _given_sql(channels: int, size: int, capped: bool) -> str:
    """From ex (row, band, above, e) to what each band gets."""
    burst = f"((before + cost) >> 6) > {2 * size // 3}" if capped else "false"
    return f"""sp AS (SELECT row, band, width * {channels} AS w, e, above, least(e * {0.5 if capped else 1.0} * (CASE WHEN band < 8 THEN 2.0 WHEN band >= 12 THEN 0.5 ELSE 1.0 END), 4.0)::DOUBLE AS v FROM ex JOIN nf USING (band)),
bo AS (SELECT *, floor(CASE WHEN w < 6 THEN v WHEN w > 48 THEN v * 8 ELSE v * w / 6 END)::BIGINT AS b FROM sp), co AS (SELECT *, CASE WHEN w < 6 THEN b * w * 8 WHEN w > 48 THEN b * w ELSE b * 48 END AS cost FROM bo),
cu AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY row ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM co), fb AS (SELECT row, min(CASE WHEN {burst} THEN band END) AS stop, max(above) AS top FROM cu GROUP BY row),
m1 AS (SELECT a.row, a.band, max(b.above - 2.0 * (a.band - b.band)) AS m FROM ex a JOIN ex b ON b.row = a.row AND b.band <= a.band GROUP BY a.row, a.band), m2 AS (SELECT a.row, a.band, max(b.m - 3.0 * (b.band - a.band)) AS m FROM m1 a JOIN m1 b ON b.row = a.row AND b.band >= a.band GROUP BY a.row, a.band),
gv AS (SELECT row, band, CASE WHEN band = stop THEN {2 * size // 3 << 6} - before WHEN stop IS NULL OR band < stop THEN b ELSE 0 END::BIGINT AS boost, floor(0.5 + 13 * pow(2.0::DOUBLE, least(e, 4.0)))::BIGINT AS importance, (32 >> greatest(least(-floor(0.5 + above - greatest(0, top - 12, m))::BIGINT, 5), 0))::BIGINT AS weight, greatest(top, -31.9::DOUBLE) AS depth,
CASE WHEN stop IS NULL THEN sum(cost) OVER (PARTITION BY row) ELSE {2 * size // 3 << 6} END::BIGINT AS total FROM cu JOIN fb USING (row) JOIN m2 USING (row, band))"""


def _levels(spark, sf_dir):
    """clip and the log amplitudes of its 21 bands over their means, in 1024ths."""
    framed = clips(spark, sf_dir).select("clip", F.concat("samples", F.array_repeat(F.lit(0.0), 2048 - 1152)).alias("s"))
    lines = spectra.transform(framed, "s", spectra.mdct_matrix(1024, T.sine_window(2048))[:, :800], "lines")
    level = lambda a, b, m: F.round((_EXPANDED * F.log2(F.sqrt(1e-27 + F.aggregate(F.slice("lines", a * 8 + 1, (b - a) * 8), F.lit(0.0), lambda s, v: s + v * v))) - m) * 1024) / 1024
    return lines.select("clip", F.array(*(level(a, b, m) for a, b, m in zip(B.EDGES, B.EDGES[1:], B.MEANS, strict=False))).alias("x"))


def _given(df, row):
    each = F.arrays_zip("b.boost", "b.importance", "b.weight")
    long = df.select(row, F.col("b.depth").alias("depth"), F.col("b.total").alias("total"), F.posexplode(each).alias("band", "g"))
    return long.select(row, F.col("band").cast("long").alias("band"), "g.boost", "g.importance", "g.weight", "total", _r("depth", 11).alias("depth"))


@query(f"WITH {_LEVELS}, ex AS (SELECT clip AS row, band, x - noise AS above, greatest(0, x - f) AS e FROM fo), {_given_sql(1, 160, False)} SELECT row AS clip, band::BIGINT AS band, boost, importance, weight, total, {rounded('depth', 11)} AS depth FROM gv")
def band_boosts(spark, sf_dir):
    """What each band of a clip gets beyond the others, its importance and its weight for spreading."""
    return _given(_levels(spark, sf_dir).select("clip", B.boosts([F.col("x")], 3, 160).alias("b")), "clip")


@query(f"""WITH {_LEVELS}, cp AS (SELECT a.clip // 2 AS row, a.band, a.noise, a.x AS x0, b.x AS x1, a.f AS f0, greatest(b.f, a.f - 4.0) AS f1 FROM fo a JOIN fo b ON b.clip = a.clip + 1 AND b.band = a.band WHERE a.clip % 2 = 0),
ex AS (SELECT row, band, greatest(x0 - noise, x1 - noise) AS above, 0.5 * (greatest(0, x0 - greatest(f0, f1 - 4.0)) + greatest(0, x1 - f1)) AS e FROM cp), {_given_sql(2, 52, True)} SELECT row AS pair, band::BIGINT AS band, boost, importance, weight, total, {rounded('depth', 11)} AS depth FROM gv""")
def stereo_boosts(spark, sf_dir):
    """The same for clips 2k and 2k + 1 as channels, in frames of 52 bytes at a constant rate."""
    pairs = _paired(_levels(spark, sf_dir), "x")
    return _given(pairs.select("pair", B.boosts([F.col("left"), F.col("right")], 3, 52, capped=True).alias("b")), "pair")


#: Two channels in the longest frames, with rows and caps by rule.
_MODE = A.Mode(A.ruled_rows(), A.ruled_caps(), 2, 3)
_MODE_BANDS = ", ".join(f"({j}, {a}, {b}, {w})" for j, (a, b, w) in enumerate(zip(B.EDGES, B.EDGES[1:], B.LOG_WIDTHS, strict=False)))
_CHOICES = f"({list(A.CHOICE)})"


def _kept_sql(name: str, source: str, step: str) -> str:
    """What a curve gives each band: up to the last that reaches its threshold, capped, and floors above."""
    return f"""{name} AS (SELECT block, {step}, j, least(cap, CASE WHEN max((bits >= least)::INT) OVER (PARTITION BY block, {step} ORDER BY j DESC) = 1 THEN bits WHEN bits >= 16 THEN 16 ELSE 0 END) AS kept FROM {source}),
{name}s AS (SELECT block, {step}, sum(kept)::BIGINT AS spent FROM {name} GROUP BY block, {step})"""


@query(f"""WITH RECURSIVE {PX}, bd(j, lo, hi, lw) AS (VALUES {_MODE_BANDS}), rl AS (SELECT r, j, CASE WHEN r = 0 THEN 0 ELSE greatest(0, least(200, 80 + 12 * r - (9 * j * (11 - r)) // 11)) END AS v FROM (SELECT unnest(range(11)) AS r) CROSS JOIN (SELECT unnest(range(21)) AS j)),
bn AS (SELECT j, lo, hi - lo AS w, lw, ((220 - 5 * j + 64) * 2 * (hi - lo) * 8) // 4 AS cap, greatest(16, (3 * (hi - lo) * 64) // 16) AS least FROM bd),
fr AS (SELECT block, sum(round(abs(x) * 4096))::BIGINT // 16 AS total, block % 11 AS trim, 5 + block % 17 AS intensity, block % 2 AS dual, block % 22 AS before FROM px GROUP BY block),
ofs AS (SELECT block, least(i // 3, 20) AS j, (CASE WHEN max(abs(x)) > 0.35 THEN 48 ELSE 0 END)::BIGINT AS o FROM px GROUP BY ALL),
bu AS (SELECT *, CASE WHEN total >= 8 THEN 8 ELSE 0 END AS flag FROM fr), bs AS (SELECT *, CASE WHEN 36 <= total - flag THEN 36 ELSE 0 END AS shared FROM bu), bb AS (SELECT *, CASE WHEN shared > 0 AND total - flag - shared >= 8 THEN 8 ELSE 0 END AS pairing FROM bs),
bt AS MATERIALIZED (SELECT block, total - flag - shared - pairing AS t, trim, intensity, dual, before, flag, shared, pairing FROM bb),
ti AS (SELECT block, bn.*, o, floor(2 * w * (trim - 8) * (20 - j) * 64 / 64.0)::BIGINT AS tilt FROM bt CROSS JOIN bn JOIN ofs USING (block, j)),
c1 AS (SELECT block, r, j, cap, least, (CASE WHEN v > 0 THEN greatest(2 * w * v * 8 // 4 + tilt, 0) ELSE 0 END + o) AS bits FROM ti JOIN rl USING (j) WHERE r > 0), {_kept_sql('k1', 'c1', 'r')},
lw AS (SELECT block, coalesce(max(CASE WHEN spent <= t THEN r END), 0) AS r FROM bt LEFT JOIN k1s USING (block) GROUP BY block),
be AS (SELECT block, ti.j, cap, least, CASE WHEN a.v > 0 THEN greatest(2 * w * a.v * 8 // 4 + tilt, 0) ELSE 0 END + CASE WHEN lw.r > 0 THEN o ELSE 0 END AS b1, CASE WHEN lw.r = 10 THEN greatest(cap + tilt, 0) WHEN b.v > 0 THEN greatest(2 * w * b.v * 8 // 4 + tilt, 0) ELSE 0 END + o AS b2
FROM ti JOIN lw USING (block) JOIN rl a ON a.j = ti.j AND a.r = lw.r LEFT JOIN rl b ON b.j = ti.j AND b.r = lw.r + 1),
c2 AS (SELECT block, m, j, cap, least, b1 + m * greatest(b2 - b1, 0) // 64 AS bits FROM be CROSS JOIN (SELECT unnest(range(64)) AS m)), {_kept_sql('k2', 'c2', 'm')},
mm AS (SELECT block, coalesce(max(CASE WHEN spent <= t THEN m END), 0) AS m FROM bt JOIN k2s USING (block) GROUP BY block),
pu AS (SELECT block, list(kept ORDER BY j) AS p, sum(kept)::BIGINT AS spent, coalesce(max(CASE WHEN o > 0 THEN j END), 0) AS held FROM k2 JOIN mm USING (block, m) JOIN ofs USING (block, j) GROUP BY block),
sk AS (SELECT block, 21::BIGINT AS coded, p, spent::BIGINT AS spent, t::BIGINT AS t, shared::BIGINT AS shared, 0::BIGINT AS side, false AS stop FROM pu JOIN bt USING (block) UNION ALL
SELECT block, CASE WHEN halt THEN coded ELSE j END::BIGINT, CASE WHEN halt THEN p ELSE list_concat(list_append(p[:j], CASE WHEN bits - 8 * asked >= 16 THEN 16 ELSE 0 END), p[j + 2:]) END,
(spent + CASE WHEN halt THEN 0 ELSE 8 * asked - p[j + 1] - shared + CASE WHEN shared > 0 THEN {_CHOICES}[j + 1] ELSE 0 END + CASE WHEN bits - 8 * asked >= 16 THEN 16 ELSE 0 END END)::BIGINT, (t + CASE WHEN j <= held THEN flag ELSE 0 END)::BIGINT, CASE WHEN halt OR shared = 0 THEN shared ELSE {_CHOICES}[j + 1] END::BIGINT, (side + 8 * asked)::BIGINT, halt
FROM (SELECT *, j <= held OR (asked = 1 AND (coded <= 2 OR bits > (CASE WHEN coded <= 17 THEN 0 WHEN j < before THEN 7 ELSE 9 END * w * 64) // 16)) AS halt FROM (SELECT *, (j > held AND bits >= greatest(least, 24))::INT AS asked FROM (SELECT *, p[j + 1] + left_ // hi * w + greatest(left_ % hi - (hi - w), 0) AS bits
FROM (SELECT sk.*, held, flag, before, bn.w, bn.least, bn.j, bn.lo + bn.w AS hi, t - sk.spent AS left_ FROM (SELECT * FROM sk WHERE NOT stop) sk JOIN (SELECT block, held FROM pu) USING (block) JOIN (SELECT block, flag, before FROM bt) USING (block) JOIN bn ON bn.j = coded - 1))))),
en AS (SELECT block, coded, p, sk.t - spent AS t, sk.shared, side, pairing, dual AS wished, CASE WHEN sk.shared > 0 THEN least(intensity, coded) ELSE 0 END AS intensity FROM sk JOIN (SELECT block, pairing, dual, intensity FROM bt) USING (block) WHERE stop),
ed AS (SELECT block, coded, p, intensity, CASE WHEN intensity > 0 THEN t ELSE t + pairing END AS t, shared, side + shared + CASE WHEN intensity > 0 THEN pairing ELSE 0 END AS side, CASE WHEN intensity > 0 AND pairing > 0 THEN wished ELSE 0 END AS dual FROM en),
sh AS (SELECT ed.*, bn.lo + bn.w AS hi FROM ed JOIN bn ON bn.j = coded - 1),
gi AS (SELECT block, bn.j, (p[bn.j + 1] + CASE WHEN bn.j < coded THEN t // hi * w + greatest(0, least(w, t % hi - lo)) ELSE 0 END)::BIGINT AS given, coded, intensity, dual FROM sh CROSS JOIN bn),
ba AS (SELECT block, (-1)::BIGINT AS j, 0::BIGINT AS balance, 0::BIGINT AS pulses, 0::BIGINT AS fine, false AS priority FROM ed UNION ALL
SELECT block, j, CASE WHEN inside THEN excess - more * 16 ELSE old END::BIGINT, CASE WHEN inside THEN kept - 16 * fine ELSE 0 END::BIGINT, CASE WHEN inside THEN fine + more ELSE given // 16 END::BIGINT, CASE WHEN NOT inside THEN given // 16 < 1 WHEN excess > 0 THEN more * 16 >= excess - old ELSE fine * den * 8 >= kept + off END
FROM (SELECT *, CASE WHEN excess > 0 THEN least(excess // 16, 8 - fine) ELSE 0 END AS more FROM (SELECT *, least(8, CASE WHEN 2 * raw > kept // 8 THEN kept // 16 ELSE raw END) AS fine FROM (SELECT *, greatest(kept + off + 4 * den, 0) // den // 8 AS raw FROM (SELECT *, o0 + CASE WHEN kept + o0 < den * 16 THEN logs // 4 WHEN kept + o0 < den * 24 THEN logs // 8 ELSE 0 END AS off FROM (SELECT *, logs // 2 - den * 21 AS o0 FROM (SELECT *, den * (lw + 24) AS logs, least(given + old, cap) AS kept, greatest(given + old - cap, 0) AS excess
FROM (SELECT gi.block, gi.j, ba.balance AS old, given, gi.j < coded AS inside, bn.cap, bn.lw, 16 * bn.w + CASE WHEN dual = 0 AND gi.j < intensity THEN 1 ELSE 0 END AS den FROM ba JOIN gi ON gi.block = ba.block AND gi.j = ba.j + 1 JOIN bn ON bn.j = gi.j)))))))),
fb AS (SELECT block, balance FROM ba WHERE j = 20)
SELECT block, j AS band, pulses, fine, priority::INT::BIGINT AS priority, coded, ed.intensity::BIGINT AS intensity, ed.dual::BIGINT AS dual, side::BIGINT AS side, fb.balance FROM ba JOIN ed USING (block) JOIN fb USING (block) WHERE j >= 0""")
def band_allocation(spark, sf_dir):
    """Pulses and fine bits of 21 bands of two channels, for budgets by loudness and boosts by peaks."""
    peaks = F.array(*(F.array_max(F.transform(F.slice("samples", 3 * j + 1, 3 if j < 20 else 4), F.abs)) for j in range(21)))
    block = F.col("block")
    frames = pcm_blocks(spark, sf_dir).select(
        "block", F.floor(F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + F.round(F.abs(x) * 4096).cast("long")) / 16).alias("total"), (block % 11).alias("trim"),
        F.transform(peaks, lambda p: F.when(p > 0.35, 48).otherwise(0)).alias("offsets"), (5 + block % 17).alias("intensity"), (block % 2).alias("dual"), (block % 22).alias("before"),
    )
    found = A.allocations(frames, ["total", "trim", "offsets", "intensity", "dual", "before"], "a", _MODE)
    each = F.arrays_zip("a.pulses", "a.fine", "a.priority")
    long = found.select("block", F.posexplode(each).alias("band", "g"), "a.coded", "a.intensity", "a.dual", "a.side", "a.balance")
    return long.select("block", F.col("band").cast("long").alias("band"), "g.pulses", "g.fine", "g.priority", "coded", "intensity", "dual", "side", "balance")
