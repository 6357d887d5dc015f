"""Scales and their inverses, masking curves, schedules, residue books and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pcm
from ..functions import transforms as T
from ..operators import curves as V
from ..operators import spectra
from ..operators.blocks import segment_sums
from ..sources.adaptors import event_signal, pcm_blocks, stereo_blocks
from .quality import _r
from .registry import EVENT_SIGNAL, PX, STEREO, query, rounded
from .spectra import _lines

_POWER = "floor(log2(abs(x)))"


@query(f"WITH {PX} SELECT block, i, {rounded(f'(CASE WHEN x = 0 THEN 0 ELSE ({_POWER} + 126 + abs(x) / pow(2.0::DOUBLE, {_POWER})) * 8388608 END) * 7.177114e-7::DOUBLE - 764.6162::DOUBLE')} AS db, CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM px")
def approximate_db(spark, sf_dir):
    """Decibels of samples by their floats' bits, and their signs as units."""
    long = pcm_blocks(spark, sf_dir).select("block", F.posexplode("samples").alias("i", "x"))
    return long.select("block", F.col("i").cast("long").alias("i"), _r(V.approximate_db(F.col("x"))).alias("db"), F.when(F.col("x") < 0, -1.0).otherwise(1.0).alias("unit"))


@query(f"""WITH {PX} SELECT block, i, {rounded('102.0::DOUBLE * z - 2.0::DOUBLE * z * z + 0.4::DOUBLE * z * z * z + pow(1.46::DOUBLE, z) - 1', 4)} AS from_bark, {rounded('1000.0::DOUBLE * exp(100 * z / 1442.695::DOUBLE) - 1000', 4)} AS from_mel, {rounded('exp((z / 4 + 5.965784::DOUBLE) * ln(2.0::DOUBLE))', 4)} AS from_octave, {rounded('exp(-5 * z * 0.11512925::DOUBLE)')} AS from_db FROM (SELECT block, i, 24 * abs(x) AS z FROM px)""")
def scale_inverses(spark, sf_dir):
    """Frequencies of Bark, mel and octave values, and amplitudes of decibels."""
    z = 24 * F.abs(F.col("x"))
    long = pcm_blocks(spark, sf_dir).select("block", F.posexplode("samples").alias("i", "x"))
    return long.select("block", F.col("i").cast("long").alias("i"), _r(V.from_bark(z), 4).alias("from_bark"), _r(V.from_mel(100 * z), 4).alias("from_mel"), _r(V.from_octave(z / 4), 4).alias("from_octave"), _r(V.from_db(-5 * z)).alias("from_db"))


_WINDOWED = "(13.1 * atan(0.00074 * 344 * k) + 2.24 * atan(344.0::DOUBLE * 344 * k * k * 1.85e-8) + 1e-4 * 344 * k)"
_WINDOWS = V.bark_windows(64, 44100, 0.5, 0.5, 3, 4)


@query(f"""WITH {PX}, kk AS (SELECT k, {_WINDOWED} AS z FROM (SELECT unnest(range(-99, 66)) AS k)), b AS (SELECT k AS i, z FROM kk WHERE k BETWEEN 0 AND 63),
w AS (SELECT i, greatest(-99, least(i - 3, (SELECT min(k) FROM kk WHERE kk.z >= b.z - 0.5))) - 1 AS lo, least(65, greatest(i + 4, coalesce((SELECT min(k) FROM kk WHERE kk.z >= b.z + 0.5 AND k BETWEEN 1 AND 64), 65))) - 1 AS hi FROM b)
SELECT px.block, w.i::BIGINT AS bin, (w.lo * 65536 + w.hi)::BIGINT AS packed, {rounded('sum(abs(q.x))')} AS level FROM px JOIN w USING (i) JOIN px q ON q.block = px.block AND q.i BETWEEN greatest(w.lo, 0) AND least(w.hi, 63) GROUP BY px.block, w.i, w.lo, w.hi""")
def bark_windows(spark, sf_dir):
    """The noise window of each bin in Bark, and the level within it."""
    around = F.array(*(F.struct(F.lit(lo * 65536 + hi).cast("long").alias("packed"), F.lit(max(lo, 0)).alias("lo"), F.lit(min(hi, 63)).alias("hi")) for lo, hi in _WINDOWS))
    levels = F.transform(around, lambda w: F.struct(w["packed"].alias("packed"), pcm.total(F.slice("samples", w["lo"] + 1, w["hi"] - w["lo"] + 1), F.abs).alias("level")))
    long = pcm_blocks(spark, sf_dir).select("block", F.posexplode(levels).alias("bin", "w"))
    return long.select("block", F.col("bin").cast("long").alias("bin"), "w.packed", _r("w.level").alias("level"))


@query(f"""WITH {STEREO}, c AS (SELECT pair, i, 60 * l - 20 AS noise, 60 * r - 30 AS tone, 60 * r - 10 AS line, i / 8.0::DOUBLE - 4 AS off FROM st) SELECT pair, i, {rounded('greatest(least(noise + off, 0.0::DOUBLE), tone + 3)')} AS mask,
{rounded('CASE WHEN least(noise + off, 0.0::DOUBLE) - line + 17.2 > 0 THEN (CASE WHEN 1 - (least(noise + off, 0.0::DOUBLE) - line + 17.2) * 0.005 < 0 THEN 0.0001 ELSE 1 - (least(noise + off, 0.0::DOUBLE) - line + 17.2) * 0.005 END) ELSE 1 - (least(noise + off, 0.0::DOUBLE) - line + 17.2) * 0.0003 END')} AS gain FROM c""")
def mixed_masks(spark, sf_dir):
    """Noise floor and tone mask mixed, and the companding gain of each line against the floor."""
    levels = F.zip_with("left", "right", lambda a, b: F.struct((60 * a - 20).alias("noise"), (60 * b - 30).alias("tone"), (60 * b - 10).alias("line")))
    long = stereo_blocks(spark, sf_dir).select("pair", F.posexplode(levels).alias("i", "c"))
    offset = F.col("i") / 8 - 4
    return long.select("pair", F.col("i").cast("long").alias("i"), _r(V.mixed_mask(F.col("c.noise"), F.col("c.tone"), offset, 3.0, 0.0)).alias("mask"), _r(V.companding_gain(F.col("c.noise"), F.col("c.line"), offset, 1.0)).alias("gain"))


@query(f"""WITH {PX}, e AS (SELECT block, i // 4 AS s, sum(x * x) AS e FROM px GROUP BY block, s), r AS (SELECT block, s, e, max(e) OVER (PARTITION BY block) AS top, avg(e) OVER (PARTITION BY block ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT block, bool_or(s > 0 AND e > 3 * greatest(before, top * 0.001) AND e > 0.05 * top) AND max(top) > 0 AS onset FROM r GROUP BY block""")
def sharp_onsets(spark, sf_dir):
    """Sixteen parts of a block: one over so many times the mean of all before it (3 here)."""
    return pcm_blocks(spark, sf_dir).select("block", V.sharp_onset(segment_sums(F.col("samples"), 4, 16), 3.0).alias("onset"))


@query(f"""WITH {EVENT_SIGNAL}, fl AS (SELECT user_id, i, x > 0.6 AND i > 0 AND lead(i) OVER (PARTITION BY user_id ORDER BY i) IS NOT NULL AS t FROM ev), a AS (SELECT *, NOT coalesce(lag(t) OVER w, false) AS l, NOT coalesce(lead(t) OVER w, false) AS r, i - row_number() OVER (PARTITION BY user_id, t ORDER BY i) AS g FROM fl WINDOW w AS (PARTITION BY user_id ORDER BY i)),
b AS (SELECT *, min(i) OVER (PARTITION BY user_id, t, g) AS first FROM a)
SELECT user_id, ((i + 1) * 1024)::BIGINT AS centre, true AS long, l AS "left", r AS "right" FROM b WHERE NOT t UNION ALL SELECT user_id, (first * 1024 + 576 + 128 * (8 * (i - first) + j))::BIGINT, false, false, false FROM b CROSS JOIN (SELECT unnest(range(8)) AS j) WHERE t""")
def block_centres(spark, sf_dir):
    """Long and short blocks of each user's signal with their centres and window flags; first and last slots stay long."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("i")
    slots = event_signal(spark, sf_dir).withColumn("transient", (F.col("x") > 0.6) & (F.col("i") > 0) & F.lead("i").over(order).isNotNull())
    return V.schedule(slots.select("user_id", "i", "transient"), "user_id", "i", "transient")


_ENTRY = "greatest(least(round(({0} - {1}) / {2}), 127.0::DOUBLE), 0.0::DOUBLE)"
_COARSE, _FINE = _ENTRY.format("v", "(-256.0::DOUBLE)", "4"), "(-16.0::DOUBLE)"


@query(f"""WITH {PX}, p AS (SELECT stream_id, block, 80 * x AS v, max(abs(80 * x)) OVER (PARTITION BY block, i // 16) AS top FROM px), c AS (SELECT *, {_COARSE} AS ce FROM p WHERE top > 0),
h AS (SELECT stream_id, 'coarse' AS stage, ce AS entry FROM c WHERE top > 15 UNION ALL SELECT stream_id, 'fine', {_ENTRY.format('(CASE WHEN top > 15 THEN v - (ce * 4 - 256) ELSE v END)', _FINE, '0.25')} FROM c)
SELECT stream_id, stage, entry::BIGINT AS entry, count(*)::BIGINT AS n FROM h GROUP BY stream_id, stage, entry""")
def residue_histogram(spark, sf_dir):
    """How often a stream's residues use each entry of the coarse and the fine book."""
    parts = pcm.each(4, lambda k: V.cascade(F.transform(F.slice("samples", k * 16 + 1, 16), lambda x: 80 * x)))
    used = pcm_blocks(spark, sf_dir).select("stream_id", F.explode(F.flatten(parts)).alias("u")).select("stream_id", "u.*")
    return used.groupBy("stream_id", "stage", "entry").agg(F.count("*").alias("n"))


@query(f"""WITH {STEREO}, k AS (SELECT unnest(range(32)) AS k), m AS (SELECT pair, k.k, sum(l * sin(pi() / 64 * (i + 0.5)) * cos(pi() / 32 * (i + 0.5 + 16) * (k.k + 0.5))) AS c, max(CASE WHEN i = k.k THEN 0.05 + abs(r) END) AS f FROM st CROSS JOIN k GROUP BY pair, k.k)
SELECT pair, k::BIGINT AS line, {rounded('c / f')} AS residue FROM m""")
def floor_residue(spark, sf_dir):
    """Lines over their floor."""
    lines = F.zip_with(T.mdct(F.col("left"), 32, T.sine_window(64)), F.transform(F.slice("right", 1, 32), lambda x: 0.05 + F.abs(x)), lambda c, f: c / f)
    return _lines(stereo_blocks(spark, sf_dir), "pair", lines, "line", "residue")


@query(f"WITH {STEREO} SELECT pair, coalesce(sum(l * r) / nullif(sqrt(sum(l * l)) * sqrt(sum(r * r)), 0) >= 0.9, false) AS coupled, coalesce(sum(l * (0.9 * l + 0.1 * r)) / nullif(sqrt(sum(l * l)) * sqrt(sum((0.9 * l + 0.1 * r) * (0.9 * l + 0.1 * r))), 0) >= 0.9, false) AS mixed FROM st GROUP BY pair")
def coupled_channels(spark, sf_dir):
    """Whether left is correlated enough for coupling (0.9) with right, and with itself mixed with a little of right."""

    def coupled(a, b):
        size = F.sqrt(pcm.dot(a, a)) * F.sqrt(pcm.dot(b, b))
        return F.when(size > 0, pcm.dot(a, b) / size >= 0.9).otherwise(False)

    mixed = F.zip_with("left", "right", lambda a, b: 0.9 * a + 0.1 * b)
    return stereo_blocks(spark, sf_dir).select("pair", coupled(F.col("left"), F.col("right")).alias("coupled"), coupled(F.col("left"), mixed).alias("mixed"))


@query(f"""WITH RECURSIVE {PX}, k AS (SELECT unnest(range(5)) AS lag), c AS (SELECT a.block, k.lag, sum(a.x * b.x) AS v FROM px a CROSS JOIN k JOIN px b ON b.block = a.block AND b.i = a.i + k.lag GROUP BY a.block, k.lag), r AS (SELECT block, list(v ORDER BY lag) AS r FROM c GROUP BY block),
l AS (SELECT block, r, 0 AS i, r[1] AS e, []::DOUBLE[] AS a FROM r
UNION ALL SELECT block, r, i + 1, e * (1 - k * k), list_append([a[j] - k * a[i + 1 - j] FOR j IN range(1, i + 1)], k) FROM (SELECT block, r, i, e, a, (r[i + 2] - coalesce(list_sum([a[j] * r[i + 2 - j] FOR j IN range(1, i + 1)]), 0)) / e AS k FROM l WHERE i < 4)),
d AS (SELECT l.block, [a[j] * pow(0.99::DOUBLE, j) FOR j IN range(1, 5)] AS a, (SELECT list(x ORDER BY i) FROM px WHERE px.block = l.block AND px.i >= 60) AS w FROM l WHERE l.i = 4),
p AS (SELECT block, a, w, 0 AS n FROM d UNION ALL SELECT block, a, list_append(w, list_sum([a[j] * w[len(w) + 1 - j] FOR j IN range(1, 5)])), n + 1 FROM p WHERE n < 8)
SELECT block, (u.k - 5)::BIGINT AS i, {rounded('w[u.k]')} AS value FROM p CROSS JOIN (SELECT unnest(range(5, 13)) AS k) u WHERE n = 8""")
def predicted_samples(spark, sf_dir):
    """Eight samples past each block, by a damped predictor of four taps."""
    taps = pcm_blocks(spark, sf_dir).withColumn("a", spectra.levinson(spectra.autocorrelation(F.col("samples"), 64, 5), 4))
    more = pcm.let(F.struct("a", "samples"), lambda s: V.predicted(V.damped(s["a"]), s["samples"], 8))
    return _lines(taps, "block", more, "i")
