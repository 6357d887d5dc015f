"""Noise budgets by band, scale factors that keep to them, and the entropy of whole granules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import hearing as H
from ..functions import pcm
from ..functions import transforms as T
from ..operators import filterbank as B
from ..operators import noise as N
from ..operators import rate as R
from ..operators import spectra
from ..sources.adaptors import clips, pcm_blocks
from .filterbank import LONG, granules
from .hearing import _BARK, _SPECTRUM, BINS, HZ, RATE, _spectrum
from .quality import _r
from .registry import CLIPS, PX, query, rounded
from .spectra import _lines

_OWN = f"""{_SPECTRUM}, zz AS (SELECT k, {_BARK.format(HZ)} AS z FROM kk), tw AS (SELECT a.block, a.k, greatest(least(10 * (avg(ln(greatest(b.p, 1e-12))) / ln(10) - log10(avg(greatest(b.p, 1e-12)))) / -60, 1.0::DOUBLE), 0.0::DOUBLE) AS t FROM sp a JOIN sp b ON b.block = a.block AND b.k BETWEEN a.k - 8 AND a.k + 8 GROUP BY a.block, a.k),
wp AS (SELECT block, k, p * pow(10, -(t * 18 + (1 - t) * 6) / 10) AS w FROM sp JOIN tw USING (block, k)),
th AS (SELECT wp.block, a.k, sum(w * pow(10, (15.81 + 7.5 * (a.z - b.z + 0.474) - 17.5 * sqrt(1 + pow(a.z - b.z + 0.474, 2))) / 10)) AS thr FROM wp JOIN zz b ON b.k = wp.k CROSS JOIN zz a GROUP BY wp.block, a.k)"""


@query(f"WITH {_OWN} SELECT block, k::BIGINT AS bin, {rounded('thr')} AS threshold FROM th")
def masking_by_masker(spark, sf_dir):
    """Power that a block's bins mask, each masker lowered by its own tonality before it is spread."""
    found = _spectrum(spark, sf_dir).withColumn("w", N.weighted_power(F.col("power"), N.windowed_tonality(F.col("power"), BINS)))
    matrix = F.array(*(F.lit(row) for row in H.spread_matrix(BINS, RATE)))
    return _lines(found, "block", F.transform(matrix, lambda row: pcm.dot(F.col("w"), row)), "bin", "threshold")


#: Bands of 32 lines, some narrower than a bin of the 16-point spectrum.
_NARROW = ((0, 2), (2, 3), (3, 6), (6, 7), (7, 12), (12, 20), (20, 32))
_BINS = N.bins_of(_NARROW, 1.0, 4.0, 9)
_NARROW_SQL = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(_NARROW))
_BINS_SQL = ", ".join(f"({k}, {b})" for k, held in enumerate(_BINS) for b in held)
_STEP = 0.2
_GAIN = 2.0 ** ((min(max(math.floor(210 + 16 / 3 * math.log2(_STEP) + 0.5), 0), 255) - 210) / 4)
_CAPS = (4, 4, 4, 4, 3, 3, 3)
_ALLOWED = f"""{PX}, kk AS (SELECT unnest(range(9)) AS k), dd AS (SELECT block, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - 24) / 16)) * cos(2 * pi() * k * (i - 24) / 16)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - 24) / 16)) * sin(2 * pi() * k * (i - 24) / 16)) AS im FROM px CROSS JOIN kk WHERE i >= 24 AND i < 40 GROUP BY block, k),
sp AS (SELECT block, k, re * re + im * im AS p FROM dd), zz AS (SELECT k, {_BARK.format(f'(k * {RATE}::DOUBLE / 16)')} AS z FROM kk),
th AS (SELECT s.block, a.k, sum(s.p * pow(10, (15.81 + 7.5 * (a.z - b.z + 0.474) - 17.5 * sqrt(1 + pow(a.z - b.z + 0.474, 2))) / 10)) * pow(10, -1.2) AS thr FROM sp s JOIN zz b ON b.k = s.k CROSS JOIN zz a GROUP BY s.block, a.k),
ml AS (SELECT block, line, sum(x * sin(pi() / 64 * (i + 0.5)) * cos(pi() / 32 * (i + 0.5 + 16) * (line + 0.5))) AS c FROM px CROSS JOIN (SELECT unnest(range(32)) AS line) GROUP BY block, line),
bd(band, lo, hi) AS (VALUES {_NARROW_SQL}), bb(band, k) AS (VALUES {_BINS_SQL}), e AS (SELECT block, band, sum(c * c) AS e FROM ml JOIN bd ON line >= lo AND line < hi GROUP BY block, band),
f AS (SELECT block, band, sum(thr) AS t, sum(p) AS s FROM sp JOIN th USING (block, k) JOIN bb USING (k) GROUP BY block, band),
aw AS (SELECT block, band, CASE WHEN e <= 0 THEN 1e-12 WHEN s > 0 THEN greatest(t / s * e, 1e-12) ELSE 'infinity'::DOUBLE END AS allowed FROM e JOIN f USING (block, band))"""


def _budgets(spark, sf_dir):
    """block, 32 lines and the noise that each band may hold, by a 16-point spectrum of the block's middle."""
    power = T.power_spectrum(F.slice("samples", 25, 16), 16, T.hann_window(16))
    found = pcm_blocks(spark, sf_dir).select("block", T.mdct(F.col("samples"), 32, T.sine_window(64)).alias("lines"), power.alias("power"))
    found = found.withColumn("threshold", H.masking_threshold(F.col("power"), H.spread_matrix(9, RATE), F.lit(0.5)))
    budget = pcm.let(F.struct("lines", "power", "threshold"), lambda s: N.allowed(s["lines"], s["power"], s["threshold"], _NARROW, _BINS))
    return found.select("block", "lines", budget.alias("budget"))


@query(f"WITH {_ALLOWED} SELECT block, band::BIGINT AS band, {rounded('allowed')} AS allowed FROM aw")
def allowed_noise_narrow(spark, sf_dir):
    """Noise budgets where bands fall between bins: the nearest bin then stands for the band."""
    return _lines(_budgets(spark, sf_dir), "block", F.col("budget"), "band", "allowed")


_CONTROL = f"""{_ALLOWED}, cp(band, cap) AS (VALUES {', '.join(f'({k}, {c})' for k, c in enumerate(_CAPS))}), ca AS (SELECT band, unnest(range(cap + 1)) AS s, cap FROM cp),
qu AS (SELECT block, band, s, cap, abs(c) AS x, round(pow(abs(c), 0.75) / {_STEP}::DOUBLE * pow(2.0::DOUBLE, 0.375 * s)) AS q FROM ml JOIN bd ON line >= lo AND line < hi JOIN ca USING (band)),
nz AS (SELECT block, band, s, any_value(cap) AS cap, sum(pow(x - pow(q, 4.0 / 3) * {_GAIN!r}::DOUBLE * pow(2.0::DOUBLE, -0.5 * s), 2)) AS noise, max(q) AS top FROM qu GROUP BY block, band, s),
fs AS (SELECT nz.block, nz.band, coalesce(min(CASE WHEN s < cap AND NOT noise > allowed THEN s END), any_value(cap)) AS ends FROM nz JOIN aw USING (block, band) GROUP BY nz.block, nz.band),
ps AS (SELECT block, min(pass) AS over FROM fs CROSS JOIN (SELECT unnest(range({max(_CAPS) + 1})) AS pass) JOIN nz USING (block, band) WHERE s = least(ends, pass) AND top > {N.BOUND} GROUP BY block),
sf AS (SELECT fs.block, fs.band, least(ends, greatest(coalesce(over - 1, {max(_CAPS)}), 0)) AS s FROM fs LEFT JOIN ps USING (block))"""


def _controlled(spark, sf_dir):
    factors = pcm.let(F.struct("lines", "budget"), lambda s: N.scale_factors(s["lines"], s["budget"], _NARROW, _CAPS, _STEP, _GAIN))
    return _budgets(spark, sf_dir).withColumn("factors", factors)


@query(f"WITH {_CONTROL} SELECT block, band::BIGINT AS band, s::BIGINT AS scale_factor FROM sf")
def noise_control(spark, sf_dir):
    """Scale factors that the noise-control loop ends with."""
    found = _controlled(spark, sf_dir).select("block", F.posexplode("factors").alias("band", "scale_factor"))
    return found.select("block", F.col("band").cast("long").alias("band"), "scale_factor")


@query(f"WITH {_CONTROL} SELECT sf.block, {rounded('sum(CASE WHEN isfinite(allowed) THEN noise / greatest(allowed, 1e-12) ELSE 0 END)')} AS distortion, count(CASE WHEN sf.s > 0 THEN 1 END)::BIGINT AS raised, sum(sf.s)::BIGINT AS complexity FROM sf JOIN nz ON nz.block = sf.block AND nz.band = sf.band AND nz.s = sf.s JOIN aw ON aw.block = sf.block AND aw.band = sf.band GROUP BY sf.block")
def perceptual_distortion(spark, sf_dir):
    """Noise over budget, summed over bands, and how complex the factors are."""
    noises = F.array(*(N.noise(F.slice("lines", lo + 1, hi - lo), _STEP, _GAIN, F.get("factors", k)) for k, (lo, hi) in enumerate(_NARROW)))
    found = _controlled(spark, sf_dir)
    return found.select("block", _r(N.distortion(noises, F.col("budget"))).alias("distortion"), pcm.count_where(F.col("factors"), lambda s: s > 0).cast("long").alias("raised"), F.aggregate("factors", F.lit(0).cast("long"), lambda t, s: t + s).alias("complexity"))


# --- whole granules ------------------------------------------------------------

#: Points of the spectrum about a granule, and samples before it that they begin with.
POINTS, LEAD = 1024, (1024 - 576) // 2
_GHZ = f"(k * {RATE}::DOUBLE / 1024)"
_GRANULE = f"""{CLIPS}, wn AS (SELECT clip, g, n - 576 * g + {LEAD} AS m, x FROM cl JOIN (SELECT unnest(range(2)) AS g) ON n >= 576 * g - {LEAD} AND n < 576 * g - {LEAD} + 1024), kk AS (SELECT unnest(range(513)) AS k),
dd AS (SELECT clip, g, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * m / 1024)) * cos(2 * pi() * ((k * m) % 1024) / 1024)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * m / 1024)) * sin(2 * pi() * ((k * m) % 1024) / 1024)) AS im FROM wn CROSS JOIN kk GROUP BY clip, g, k),
gp AS (SELECT clip, g, k, re * re + im * im AS p FROM dd), gz AS (SELECT k, {_BARK.format(_GHZ)} AS z FROM kk),
gt AS (SELECT a.clip, a.g, a.k, greatest(least(10 * (avg(ln(greatest(b.p, 1e-12))) / ln(10) - log10(avg(greatest(b.p, 1e-12)))) / -60, 1.0::DOUBLE), 0.0::DOUBLE) AS t FROM gp a JOIN gp b ON b.clip = a.clip AND b.g = a.g AND b.k BETWEEN a.k - 8 AND a.k + 8 GROUP BY a.clip, a.g, a.k),
gw AS (SELECT clip, g, k, p, p * pow(10, -(t * 18 + (1 - t) * 6) / 10) AS w FROM gp JOIN gt USING (clip, g, k)), gs AS (SELECT a.k AS i, b.k, pow(10, (15.81 + 7.5 * (a.z - b.z + 0.474) - 17.5 * sqrt(1 + pow(a.z - b.z + 0.474, 2))) / 10) AS s FROM gz a CROSS JOIN gz b),
gh AS (SELECT clip, g, gs.i AS k, sum(w * s) AS thr FROM gw JOIN gs USING (k) GROUP BY clip, g, gs.i)"""


def _heard(spark, sf_dir):
    """clip, granule, and the power and threshold of the 513 bins about it."""
    padded = clips(spark, sf_dir).select("clip", F.concat(F.array_repeat(F.lit(0.0), LEAD), "samples", F.array_repeat(F.lit(0.0), LEAD)).alias("s"))
    two = padded.withColumn("granule", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("clip", F.col("granule").cast("long").alias("granule"), F.slice("s", F.col("granule") * B.GRANULE + 1, POINTS).alias("s"))
    turn = 2 * np.pi / POINTS * np.outer(np.arange(POINTS), np.arange(POINTS // 2 + 1))
    both = np.asarray(T.hann_window(POINTS))[:, None] * np.concatenate([np.cos(turn), np.sin(turn)], axis=1)
    bins = POINTS // 2 + 1
    found = spectra.transform(two, "s", both, "d")
    power = F.zip_with(F.slice("d", 1, bins), F.slice("d", bins + 1, bins), lambda a, b: a * a + b * b)
    found = found.select("clip", "granule", power.alias("power"))
    found = found.withColumn("w", N.weighted_power(F.col("power"), N.windowed_tonality(F.col("power"), bins)))
    return spectra.transform(found, "w", np.asarray(H.spread_matrix(bins, RATE)).T, "threshold").drop("w")


_PE = "sum(CASE WHEN p > 0 AND thr > 0 THEN log2(2 * round(sqrt(p / thr)) + 1) ELSE 0 END)"


@query(f"WITH {_GRANULE} SELECT clip, g::BIGINT AS granule, {rounded(_PE, 4)} AS entropy FROM gw JOIN gh USING (clip, g, k) GROUP BY clip, g")
def granule_entropy(spark, sf_dir):
    """Perceptual entropy of each granule, in a window of 1024 samples about it."""
    return _heard(spark, sf_dir).select("clip", "granule", _r(H.perceptual_entropy(F.col("power"), F.col("threshold")), 4).alias("entropy"))


_BANDS = tuple(zip(B.LONG_BANDS, B.LONG_BANDS[1:], strict=False))
_GBINS = N.bins_of(_BANDS, RATE / (2 * 576), RATE / POINTS, POINTS // 2 + 1)


@query(f"""WITH {LONG}, {_GRANULE.removeprefix(CLIPS + ', ')}, lb(band, lo, hi) AS (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(_BANDS))}), lk(band, k) AS (VALUES {', '.join(f'({k}, {b})' for k, held in enumerate(_GBINS) for b in held)}),
le AS (SELECT clip, g, band, sum(v * v) AS e FROM ln JOIN lb ON line >= lo AND line < hi GROUP BY clip, g, band), lf AS (SELECT clip, g, band, sum(p) AS s, sum(thr) AS t FROM gw JOIN gh USING (clip, g, k) JOIN lk USING (k) GROUP BY clip, g, band)
SELECT clip, g::BIGINT AS granule, band::BIGINT AS band, {rounded("CASE WHEN e <= 0 THEN 1e-12 WHEN s > 0 THEN greatest(t / s * e, 1e-12) ELSE 'infinity'::DOUBLE END", 9)} AS allowed FROM le JOIN lf USING (clip, g, band)""")
def granule_analysis(spark, sf_dir):
    """Noise budgets of the 21 bands of each granule's 576 lines, from the spectrum about it, in one pass."""
    both = granules(spark, sf_dir).join(_heard(spark, sf_dir), ["clip", "granule"])
    budget = N.allowed(F.col("lines"), F.col("power"), F.col("threshold"), _BANDS, _GBINS)
    found = both.select("clip", "granule", F.posexplode(budget).alias("band", "allowed"))
    return found.select("clip", "granule", F.col("band").cast("long").alias("band"), _r("allowed", 9).alias("allowed"))


@query(f"""WITH {_GRANULE}, pe AS (SELECT clip, g, {rounded(_PE, 4)} AS e FROM gw JOIN gh USING (clip, g, k) GROUP BY clip, g), a AS (SELECT *, sum(e) OVER (PARTITION BY clip) AS mass, count(*) OVER (PARTITION BY clip) AS n FROM pe),
b AS (SELECT *, (mass <= 0) AS even, CASE WHEN mass <= 0 THEN 3048 ELSE 3048 - n * 200 END AS spare, CASE WHEN mass <= 0 THEN 1.0::DOUBLE / n ELSE e / mass END AS share FROM a), c AS (SELECT *, round(spare * share, 9) AS exact FROM b), d AS (SELECT *, floor(exact) AS down, round(exact - floor(exact), 6) AS part FROM c),
f AS (SELECT *, spare - sum(down) OVER (PARTITION BY clip) AS rest, row_number() OVER (PARTITION BY clip ORDER BY part DESC, g) AS place FROM d)
SELECT clip, g::BIGINT AS granule, e AS entropy, ((CASE WHEN even THEN 0 ELSE 200 END) + down + (CASE WHEN place <= rest THEN 1 ELSE 0 END))::BIGINT AS bits FROM f""")
def granule_allocation(spark, sf_dir):
    """A frame's 381 bytes of main data (128 kbit/s, mono), shared by the granules' entropies, 200 bits each at least."""
    heard = granule_entropy(spark, sf_dir)
    return R.allocate(heard, ["clip"], "granule", "entropy", 8 * 381, 200).select("clip", "granule", "entropy", "bits")
