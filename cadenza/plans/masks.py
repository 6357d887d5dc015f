"""Tone seeds, tone mask, noise floor and full mask of whole spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import curves as V
from ..operators import regions as R
from ..operators import tonemask as M
from .hearing import _SPECTRUM, BINS, _spectrum
from .quality import _r
from .registry import query, rounded

RATE = 44100
MAP = M.OctaveMap(BINS, RATE, 4)
CURVES = M.ruled_curves()
QUIET = np.array([0.05 * (k - 8.0) ** 2 - 10 for k in range(BINS)])
WINDOWS = V.bark_windows(BINS, RATE, 0.5, 0.5, 2, 3)
FIXED = 8

#: Decibels of bins in sixteenths (so that running sums are exact), the threshold in quiet hung below the loudest, and the octave lines of bins.
_DB = f"""{_SPECTRUM}, db AS MATERIALIZED (SELECT block, k AS i, round((10 * log10(greatest(p, 1e-12)) - 20) * 16) / 16 AS f FROM sp), tp AS (SELECT block, max(f) AS loudest FROM db GROUP BY block),
fl AS (SELECT block, i, 0.05::DOUBLE * (i - 8) * (i - 8) - 10 + greatest(loudest - 140, -140) AS v FROM db JOIN tp USING (block)),
om AS (SELECT i, trunc((ln((i + 0.25::DOUBLE) * 0.5 * {RATE} / {BINS}) * 1.442695 - 5.965784) * 32 + 0.5)::BIGINT AS oc FROM (SELECT unnest(range({BINS})) AS i)),
oz AS (SELECT trunc((ln(0.25::DOUBLE * 0.5 * {RATE} / {BINS}) * 1.442695 - 5.965784) * 32 - 4)::BIGINT AS f0, trunc((ln({BINS}.25::DOUBLE * 0.5 * {RATE} / {BINS}) * 1.442695 - 5.965784) * 32 + 0.5)::BIGINT AS f1),
ru AS (SELECT oc, max(i) AS last FROM om GROUP BY oc)"""
#: Curves by their rule on the octave lines, the loudest on each.
_SEEDS = f"""{_DB}, pk AS (SELECT block, om.oc, any_value(last) AS last, max(f) AS peak FROM db JOIN om USING (i) JOIN ru ON ru.oc = om.oc GROUP BY block, om.oc),
hd AS (SELECT pk.block, oc, peak, greatest(least(floor((peak + 105 - loudest - 30) * 0.1), 7), 0)::BIGINT AS lv, greatest(least(oc >> 4, 16), 0) AS band FROM pk JOIN tp USING (block) JOIN fl ON fl.block = pk.block AND fl.i = last WHERE peak + 6 > v),
ct AS (SELECT block, oc - f0 + (pt - 16) * 4 - 2 AS line, peak - 12 - 0.5 * band - (CASE WHEN pt > 16 THEN (3 - 0.25 * lv) * (pt - 16) ELSE 6 * (16 - pt) END) AS v FROM hd CROSS JOIN oz CROSS JOIN (SELECT unnest(range(56)) AS pt) WHERE pt - 16 >= -6 - lv AND pt - 16 < 10 + 3 * lv),
sd AS MATERIALIZED (SELECT b.block, l.line, coalesce(max(ct.v), -9999.0::DOUBLE) AS v FROM tp b CROSS JOIN (SELECT unnest(range(f1 - f0 + 1)) AS line FROM oz) l LEFT JOIN ct ON ct.block = b.block AND ct.line = l.line AND l.line > 0 GROUP BY b.block, l.line)"""
#: The stack of each block by recursion, a push or a pop at each step, and what it leaves on each line.
_CHASED = f"""{_SEEDS}, sl AS (SELECT block, list(v ORDER BY line) AS s FROM sd GROUP BY block),
sk AS (SELECT block, 0::BIGINT AS i, []::BIGINT[] AS ps, []::DOUBLE[] AS am FROM sl UNION ALL
SELECT sk.block, CASE WHEN pop THEN i ELSE i + 1 END, CASE WHEN pop THEN ps[:-2] ELSE list_append(ps, i) END, CASE WHEN pop THEN am[:-2] ELSE list_append(am, v) END FROM (SELECT sk.*, s[i + 1] AS v, len(ps) > 1 AND s[i + 1] >= am[-1] AND i < ps[-1] + 4 AND am[-1] <= am[-2] AND i < ps[-2] + 4 AS pop FROM sk JOIN sl USING (block) WHERE i < len(s)) sk),
sf AS (SELECT block, ps, am FROM sk JOIN oz ON i = f1 - f0 + 1), en AS (SELECT block, j, am[j] AS v, CASE WHEN j < len(am) AND am[j + 1] > am[j] THEN ps[j + 1] ELSE ps[j] + 5 END AS stop FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM sf)),
ch AS MATERIALIZED (SELECT sd.block, sd.line, coalesce(arg_min(en.v, en.j), any_value(sd.v)) AS v FROM sd LEFT JOIN en ON en.block = sd.block AND en.stop > sd.line GROUP BY sd.block, sd.line)"""
#: Lines that each bin reads, by recursion along the map, and the mask of each bin.
_TONE = f"""{_CHASED}, wk AS (SELECT (SELECT oc FROM om WHERE i = 0) - f0 - 2 AS lo, (SELECT oc FROM om WHERE i = 0) - f0 - 2 AS hi, 0::BIGINT AS a, 0::BIGINT AS b, f0 FROM oz UNION ALL
SELECT hi, greatest(hi, ((x.oc + y.oc) >> 1) - f0), wk.b, (SELECT count(*) FROM om WHERE oc <= greatest(hi, ((x.oc + y.oc) >> 1) - f0) + f0), f0 FROM wk JOIN om x ON x.i = wk.b JOIN om y ON y.i = wk.b + 1),
ms AS (SELECT ch.block, wk.a, wk.b, min(CASE WHEN line = lo THEN least(v, -40) ELSE v END) AS v FROM ch JOIN wk ON line >= lo AND line <= hi AND b > a WHERE v > -9999 GROUP BY ch.block, wk.a, wk.b
UNION ALL SELECT block, (SELECT max(b) FROM wk), {BINS}, v FROM ch JOIN oz ON line = f1 - f0), tn AS MATERIALIZED (SELECT fl.block, fl.i, greatest(fl.v, coalesce(ms.v, -9999)) AS v FROM fl LEFT JOIN ms ON ms.block = fl.block AND fl.i >= ms.a AND fl.i < ms.b)"""
_BARK = "(13.1::DOUBLE * atan(0.00074 * {0}) + 2.24 * atan({0} * {0} * 1.85e-8) + 1e-4 * {0})".format(f"({RATE // (2 * BINS)} * k)")
_NOISE = f"""bk AS (SELECT k, {_BARK} AS z FROM (SELECT unnest(range(-99, {BINS + 2})) AS k)),
bw AS MATERIALIZED (SELECT a.k AS i, greatest(-99, least(a.k - 2, min(b.k) FILTER (b.z >= a.z - 0.5))) - 1 AS lo, least({BINS + 1}, greatest(a.k + 3, coalesce(min(b.k) FILTER (b.z >= a.z + 0.5 AND b.k BETWEEN 1 AND {BINS}), {BINS + 1}))) - 1 AS hi FROM bk a CROSS JOIN bk b WHERE a.k >= 0 AND a.k < {BINS} GROUP BY a.k, a.z),
yy AS (SELECT block, i, greatest(f + 140, 1) AS y, CASE WHEN i = 0 THEN 0.5 ELSE 1.0 END AS h FROM db),
mo AS MATERIALIZED (SELECT block, i, sum(h * y * y) OVER w AS n, sum(CASE WHEN i = 0 THEN h ELSE i END * y * y) OVER w AS x, sum(i * i * y * y) OVER w AS xx, sum(h * y * y * y) OVER w AS y, sum(i * y * y * y) OVER w AS xy FROM yy WINDOW w AS (PARTITION BY block ORDER BY i)),
wn AS MATERIALIZED (SELECT 0 AS pass, i, lo, hi FROM bw UNION ALL SELECT 1, k, k + {FIXED // 2 - FIXED}, k + {FIXED // 2} FROM (SELECT unnest(range({BINS})) AS k)),
ml AS (SELECT block, list(n ORDER BY i) AS n, list(x ORDER BY i) AS x, list(xx ORDER BY i) AS xx, list(y ORDER BY i) AS y, list(xy ORDER BY i) AS xy FROM mo GROUP BY block),
ln AS MATERIALIZED (SELECT block, pass, i, n[hi + 1] + sg * n[abs(lo) + 1] AS n, x[hi + 1] - x[abs(lo) + 1] AS x, xx[hi + 1] + sg * xx[abs(lo) + 1] AS xx, y[hi + 1] + sg * y[abs(lo) + 1] AS y, xy[hi + 1] - xy[abs(lo) + 1] AS xy FROM ml CROSS JOIN (SELECT *, CASE WHEN lo < 0 THEN 1 ELSE -1 END AS sg FROM wn WHERE hi < {BINS} AND abs(lo) < {BINS})),
lt AS MATERIALIZED (SELECT pass, max(i) AS last FROM wn WHERE hi < {BINS} AND abs(lo) < {BINS} GROUP BY pass),
fit AS MATERIALIZED (SELECT ln.block, ln.pass, u.i, (y * xx - x * xy + u.i * (n * xy - x * y)) / (n * xx - x * x) AS r FROM (SELECT unnest(range({BINS})) AS i) u CROSS JOIN lt JOIN ln ON ln.pass = lt.pass AND ln.i = least(u.i, lt.last)),
nf AS MATERIALIZED (SELECT block, i, greatest(max(CASE WHEN pass = 0 THEN r END), 0) - 140 AS near, max(CASE WHEN pass = 1 THEN r END) - 140 AS fixed FROM fit GROUP BY block, i)"""


def _levels(spark, sf_dir):
    db = F.transform("power", lambda p: F.round((10 * F.log10(F.greatest(p, F.lit(1e-12))) - 20) * 16) / 16)
    return _spectrum(spark, sf_dir).select("block", db.alias("f"))


def _floor(f):
    return QUIET + np.maximum(f.max(1) - 140.0, -140.0)[:, None]


def _long(found, column, name, digits=6):
    long = found.select("block", F.posexplode(column).alias("i", "v"))
    return long.select("block", F.col("i").cast("long").alias(name), _r("v", digits).alias(column))


@query(f"WITH RECURSIVE {_CHASED} SELECT block, line::BIGINT AS line, {rounded('v')} AS seed FROM ch")
def tone_seeds(spark, sf_dir):
    """Tone curves of a spectrum's peaks on octave lines, covered ones taken away, the others held."""
    run = lambda f: {"seed": M.chase(M.seeds(f, _floor(f), MAP, CURVES), MAP.per)}
    return _long(R.by_rows(_levels(spark, sf_dir), "f", BINS, {"seed": "array<double>"}, run), "seed", "line")


@query(f"WITH RECURSIVE {_TONE} SELECT block, i::BIGINT AS bin, {rounded('v')} AS mask FROM tn")
def tone_mask(spark, sf_dir):
    """The threshold in quiet below the loudest bin, raised by the seeds over each bin."""
    run = lambda f: {"mask": M.tone_mask(f, QUIET, MAP, CURVES)}
    return _long(R.by_rows(_levels(spark, sf_dir), "f", BINS, {"mask": "array<double>"}, run), "mask", "bin")


@query(f"WITH {_DB}, {_NOISE} SELECT block, i::BIGINT AS bin, {rounded('least(near, fixed)', 4)} AS noise FROM nf")
def bark_noise_floor(spark, sf_dir):
    """The noise floor over Bark windows, mirrored at zero, and no higher than that over windows of eight bins."""
    run = lambda f: {"noise": M.noise_floor(f, WINDOWS, fixed=FIXED)}
    found = R.by_rows(_levels(spark, sf_dir), "f", BINS, {"noise": "array<double>"}, run)
    return _long(found, "noise", "bin", 4)


@query(f"WITH RECURSIVE {_TONE}, {_NOISE} SELECT nf.block, nf.i::BIGINT AS bin, {rounded('greatest(least(near - 6, 0), tn.v)', 4)} AS mask FROM nf JOIN tn USING (block, i)")
def log_mask(spark, sf_dir):
    """The full mask: the louder of the raised noise floor over Bark windows and the tone mask."""
    run = lambda f: {"mask": M.log_mask(M.noise_floor(f, WINDOWS), M.tone_mask(f, QUIET, MAP, CURVES), np.full(BINS, -6.0))}
    return _long(R.by_rows(_levels(spark, sf_dir), "f", BINS, {"mask": "array<double>"}, run), "mask", "bin", 4)
