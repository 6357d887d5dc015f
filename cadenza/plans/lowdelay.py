"""Stereo decisions, pitch and comb filter of the low-delay codec."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pcm
from ..functions import transforms as T
from ..operators import lowdelay as L
from ..sources.adaptors import clips, pcm_blocks, stereo_blocks
from .quality import _r
from .registry import CLIPS, PX, STEREO, query, rounded
from .spectra import _lines

_TURN = """CASE WHEN x * x + y * y < 1e-18 THEN 0 WHEN x * x < y * y THEN pi() / 2 - x * y * (y * y + 0.43157974::DOUBLE * x * x) / ((y * y + 0.67848403::DOUBLE * x * x) * (y * y + 0.08595542::DOUBLE * x * x))
ELSE x * y * (x * x + 0.43157974::DOUBLE * y * y) / ((x * x + 0.67848403::DOUBLE * y * y) * (x * x + 0.08595542::DOUBLE * y * y)) END"""


@query(f"WITH {STEREO}, e AS (SELECT pair, sqrt(1e-15 + sum((l + r) * (l + r))) AS x, sqrt(1e-15 + sum((l - r) * (l - r))) AS y FROM st GROUP BY pair) SELECT pair, floor(0.5 + 16384 * 0.63662::DOUBLE * ({_TURN}))::BIGINT AS angle FROM e")
def split_angle(spark, sf_dir):
    """Angle of mid and side energies in 14 bits."""
    return stereo_blocks(spark, sf_dir).select("pair", L.split_angle(F.col("left"), F.col("right")).alias("angle"))


@query(f"""WITH {STEREO}, s AS (SELECT pair, sum(l * r) * 0.8 AS x, sum(r * r) AS e FROM st GROUP BY pair), g AS (SELECT pair, 0.64 + e - 2 * x AS el, 0.64 + e + 2 * x AS er FROM s)
SELECT pair, i, {rounded('CASE WHEN el < 6e-4 OR er < 6e-4 THEN l ELSE (0.8 * l - r) / sqrt(el) END')} AS "left", {rounded('CASE WHEN el < 6e-4 OR er < 6e-4 THEN l ELSE (0.8 * l + r) / sqrt(er) END')} AS "right" FROM st JOIN g USING (pair)""")
def stereo_merge(spark, sf_dir):
    """Left and right from mid, with a gain of 0.8, and side."""
    long = stereo_blocks(spark, sf_dir).select("pair", F.posexplode(L.merged(F.col("left"), F.col("right"), F.lit(0.8))).alias("i", "s"))
    return long.select("pair", F.col("i").cast("long").alias("i"), _r("s.l").alias("left"), _r("s.r").alias("right"))


_EDGES = tuple(range(0, 65, 4))


@query(f"""WITH {STEREO}, b AS (SELECT pair, i // 4 AS band, sum(l * r) AS p, log2(sqrt(1e-27 + sum(l * l))) AS ll, log2(sqrt(1e-27 + sum(r * r))) AS lr, sum(l) AS sl FROM st GROUP BY pair, band),
t AS (SELECT pair, least(1.0::DOUBLE, abs(sum(CASE WHEN band < 8 THEN p END) / 8)) AS low, min(CASE WHEN band BETWEEN 8 AND 11 THEN abs(p) END) AS far, sum(CASE WHEN band < 15 THEN (ll + lr) * (2 + 2 * band - 16) END) / 30 AS tilt, least(abs(sum(sl)), 1.0::DOUBLE) AS tf FROM b GROUP BY pair),
u AS (SELECT *, log2(1.001 - low * low) AS a, pow(least(1.0::DOUBLE, low, far), 2) AS f FROM t)
SELECT pair, greatest(least(floor(0.5 + {4 + (8000 >> 10) / 16}::DOUBLE + greatest(-4.0::DOUBLE, 0.75 * a) - greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (tilt + 1) / 6)) - 2 * tf), 10), 0)::BIGINT AS trim, {rounded('least(0.25::DOUBLE, -0.5 * greatest(0.5 * a, log2(1.001 - f)))')} AS saving FROM u""")
def allocation_trim(spark, sf_dir):
    """Trim of the bit allocation and stereo's saving, for 16 bands at 72 kbit/s."""

    def amplitudes(c):
        return pcm.each(16, lambda k: F.log2(F.sqrt(1e-27 + pcm.total(F.slice(c, k * 4 + 1, 4), lambda v: v * v))))

    logs = [amplitudes("left"), amplitudes("right")]
    transient = F.least(F.abs(pcm.total(F.col("left"))), F.lit(1.0))
    found = stereo_blocks(spark, sf_dir).select("pair", L.trim(F.col("left"), F.col("right"), logs, _EDGES, 12, 72000, transient).alias("t"))
    return found.select("pair", "t.trim", _r("t.saving").alias("saving"))


_HALF = "hf AS (SELECT a.block, a.i // 2 AS i, 0.5 * (0.5 * (coalesce(p.x, 0) + n.x) + a.x) AS x FROM px a LEFT JOIN px p ON p.block = a.block AND p.i = a.i - 1 JOIN px n ON n.block = a.block AND n.i = a.i + 1 WHERE a.i % 2 = 0)"


@query(f"""WITH RECURSIVE {PX}, {_HALF}, c AS (SELECT a.block, k.lag, sum(a.x * b.x) * (CASE WHEN k.lag = 0 THEN 1.0001 ELSE 1 - (0.008 * k.lag) * (0.008 * k.lag) END) AS v FROM hf a CROSS JOIN (SELECT unnest(range(5)) AS lag) k JOIN hf b ON b.block = a.block AND b.i = a.i + k.lag GROUP BY a.block, k.lag), r AS (SELECT block, list(v ORDER BY lag) AS r FROM c GROUP BY block),
l AS (SELECT block, r, 0 AS i, r[1] AS e, []::DOUBLE[] AS a FROM r
UNION ALL SELECT block, r, i + 1, e * (1 - k * k), list_append([a[j] - k * a[i + 1 - j] FOR j IN range(1, i + 1)], k) FROM (SELECT block, r, i, e, a, CASE WHEN e >= 0.001 * r[1] THEN (r[i + 2] - coalesce(list_sum([a[j] * r[i + 2 - j] FOR j IN range(1, i + 1)]), 0)) / e ELSE 0 END AS k FROM l WHERE i < 4)),
t AS (SELECT block, [-a[j] * pow(0.9::DOUBLE, j) FOR j IN range(1, 5)] AS t FROM l WHERE i = 4), f AS (SELECT block, [t[1] + 0.8, t[2] + 0.8 * t[1], t[3] + 0.8 * t[2], t[4] + 0.8 * t[3], 0.8 * t[4]] AS f FROM t)
SELECT hf.block, hf.i, {rounded('any_value(hf.x) + sum(coalesce(f.f[k.k] * b.x, 0))')} AS value FROM hf JOIN f USING (block) CROSS JOIN (SELECT unnest(range(1, 6)) AS k) k LEFT JOIN hf b ON b.block = hf.block AND b.i = hf.i - k.k GROUP BY hf.block, hf.i""")
def pitch_whitened(spark, sf_dir):
    """Blocks at half rate, whitened for the pitch search."""
    half = pcm_blocks(spark, sf_dir).select("block", L.halved(F.col("samples"), 64).alias("h"))
    return _lines(half, "block", L.whitened(F.col("h"), 32), "i")


@query(f"""WITH {PX}, x AS (SELECT block, i - 32 AS i, x FROM px WHERE i >= 32), c4 AS (SELECT x.block, k.k, sum(x.x * y.x) AS xy, 1 + sum(y.x * y.x) AS yy FROM x CROSS JOIN (SELECT unnest(range(16)) AS k) k JOIN px y ON y.block = x.block AND y.i = x.i + 2 * k.k WHERE x.i % 2 = 0 GROUP BY x.block, k.k),
s4 AS (SELECT block, k, CASE WHEN xy > 0 THEN round(xy * xy / yy, 9) ELSE -1 END AS s FROM c4), r4 AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY s DESC, k) - 1 AS j, s, k FROM s4), b4 AS (SELECT block, max(CASE WHEN j = 0 THEN CASE WHEN s < 0 THEN 0 ELSE k END END) AS a, max(CASE WHEN j = 1 THEN CASE WHEN s < 0 THEN 1 ELSE k END END) AS b FROM r4 GROUP BY block),
c2 AS (SELECT x.block, k.k, sum(x.x * y.x) AS xy, 1 + sum(y.x * y.x) AS yy FROM x CROSS JOIN (SELECT unnest(range(32)) AS k) k JOIN px y ON y.block = x.block AND y.i = x.i + k.k GROUP BY x.block, k.k),
d2 AS (SELECT c2.block, k, yy, CASE WHEN abs(k - 2 * a) <= 2 OR abs(k - 2 * b) <= 2 THEN greatest(xy, -1.0::DOUBLE) ELSE 0 END AS xy FROM c2 JOIN b4 USING (block)), e2 AS (SELECT *, CASE WHEN xy > 0 THEN round(xy * xy / yy, 9) ELSE -1 END AS s FROM d2),
f2 AS (SELECT block, CASE WHEN max(s) < 0 THEN 0 ELSE arg_max(k, (s, -k)) END AS best FROM e2 GROUP BY block), g AS (SELECT f2.block, best, max(CASE WHEN k = best - 1 THEN xy END) AS a, max(CASE WHEN k = best THEN xy END) AS b, max(CASE WHEN k = best + 1 THEN xy END) AS c FROM f2 JOIN d2 USING (block) GROUP BY f2.block, best)
SELECT block, greatest(2 * best - (CASE WHEN best > 0 AND best < 31 THEN CASE WHEN c - a > 0.7 * (b - a) THEN 1 WHEN a - c > 0.7 * (b - c) THEN -1 ELSE 0 END ELSE 0 END), 0)::BIGINT AS lag FROM g""")
def pitch_search(spark, sf_dir):
    """Pitch lag of the second half of each block in the whole of it."""
    return pcm_blocks(spark, sf_dir).select("block", L.pitch(F.slice("samples", 33, 32), F.col("samples"), 32, 32).alias("lag"))


def _comb_side(t: int, gain: float, taps: tuple[float, float, float]) -> str:
    at = lambda d: f"coalesce(lag(x, {d}) OVER w, 0)"
    return f"{gain!r}::DOUBLE * ({taps[0]!r}::DOUBLE * {at(t)} + {taps[1]!r}::DOUBLE * ({at(t - 1)} + {at(t + 1)}) + {taps[2]!r}::DOUBLE * ({at(t - 2)} + {at(t + 2)}))"


@query(f"""WITH {CLIPS}, f AS (SELECT clip, n, x, CASE WHEN n < 120 THEN pow(sin(pi() / 2 * pow(sin(pi() / 2 * (n + 0.5) / 120), 2)), 2) ELSE 1 END AS s, {_comb_side(30, 0.3, L.COMB[0])} AS a, {_comb_side(47, 0.5, L.COMB[1])} AS b FROM cl WINDOW w AS (PARTITION BY clip ORDER BY n))
SELECT clip, n::BIGINT AS i, {rounded('x + (1 - s) * a + s * b')} AS value FROM f""")
def comb_filter(spark, sf_dir):
    """Clips through a comb filter that fades from one period to another."""
    found = clips(spark, sf_dir)
    value = pcm.let(F.col("samples"), lambda x: L.comb(x, 1152, (30, 0.3, 0), (47, 0.5, 1), T.overlap_window(120)))
    long = found.select("clip", F.posexplode(value).alias("i", "v"))
    return long.select("clip", F.col("i").cast("long").alias("i"), _r("v").alias("value"))
