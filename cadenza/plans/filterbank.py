"""The hybrid filterbank: subbands, long and short lines of whole granules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as T
from ..operators import filterbank as H
from ..operators import spectra
from ..sources.adaptors import clips
from .quality import _r
from .registry import CLIPS, query, rounded

_SLOTS = "sl AS (SELECT clip, n // 32 AS slot, k AS subband, -0.25 * sum(x * cos(pi() / 32 * (n % 32 + 0.5) * (k + 0.5))) AS v FROM cl CROSS JOIN (SELECT unnest(range(32)) AS k) GROUP BY clip, slot, subband)"
#: Taps of the prototype, newest sample first.
_TAPS = "tp AS (SELECT t, (CASE WHEN t // 64 % 2 = 1 THEN -1 ELSE 1 END) * (CASE WHEN t = 256 THEN 1.0::DOUBLE ELSE sin(pi() * (t - 256) / 64) / (pi() * (t - 256) / 64) END) / 64 * (0.5 - 0.5 * cos(2 * pi() * t / 512)) AS c FROM (SELECT unnest(range(512)) AS t))"
#: Subband samples of both granules of a clip, hop by hop, and the blocks of 36 of each granule.
HYBRID = f"""{CLIPS}, {_TAPS}, hp AS (SELECT clip, h, t % 64 AS y, sum(c * x) AS v FROM cl JOIN (SELECT h, t, c, 32 * h + 31 - t AS n FROM tp CROSS JOIN (SELECT unnest(range(36)) AS h)) USING (n) GROUP BY clip, h, y),
sb AS (SELECT clip, h, k, (CASE WHEN h % 2 = 1 AND k % 2 = 1 THEN -1 ELSE 1 END) * sum(v * cos((2 * k + 1) * (y - 16) * pi() / 64)) AS s FROM hp CROSS JOIN (SELECT unnest(range(32)) AS k) GROUP BY clip, h, k),
bk AS (SELECT clip, g, k, h - 18 * g + 18 AS m, s FROM sb JOIN (SELECT unnest(range(2)) AS g) ON h >= 18 * g - 18 AND h < 18 * g + 18
UNION ALL SELECT DISTINCT clip, 0, k, m, 0.0 FROM sb CROSS JOIN (SELECT unnest(range(18)) AS m))"""
_ALIAS = ", ".join(f"({k}, {c!r}::DOUBLE)" for k, c in enumerate(H.ALIAS))
LONG = f"""{HYBRID}, ml AS (SELECT clip, g, k * 18 + f AS line, sum(s * sin(pi() / 36 * (m + 0.5)) * cos(pi() / 18 * (m + 0.5 + 9) * (f + 0.5))) AS v FROM bk CROSS JOIN (SELECT unnest(range(18)) AS f) GROUP BY clip, g, line),
al(i, c) AS (VALUES {_ALIAS}), ln AS (SELECT a.clip, a.g, a.line, CASE WHEN al.c IS NULL OR b.v IS NULL THEN a.v WHEN a.line % 18 >= 9 THEN (a.v + b.v * al.c) / sqrt(1 + al.c * al.c) ELSE (a.v - b.v * al.c) / sqrt(1 + al.c * al.c) END AS v
FROM ml a LEFT JOIN al ON al.i = least(a.line % 18, 17 - a.line % 18) LEFT JOIN ml b ON b.clip = a.clip AND b.g = a.g AND b.line = (CASE WHEN a.line % 18 >= 9 THEN a.line + 2 * al.i + 1 ELSE a.line - 2 * al.i - 1 END))"""
_SHORT_BANDS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(H.SHORT_BANDS, H.SHORT_BANDS[1:], strict=False)))
SHORT = f"""{HYBRID}, ms AS (SELECT clip, g, k * 6 + f AS freq, w, sum(s * sin(pi() / 12 * (m - 6 - 6 * w + 0.5)) * cos(pi() / 6 * (m - 6 - 6 * w + 0.5 + 3) * (f + 0.5))) AS v
FROM bk JOIN (SELECT unnest(range(3)) AS w) ON m >= 6 + 6 * w AND m < 18 + 6 * w CROSS JOIN (SELECT unnest(range(6)) AS f) GROUP BY clip, g, freq, w),
bd(band, lo, hi) AS (VALUES {_SHORT_BANDS}), sh AS (SELECT clip, g, band, w, 3 * lo + w * (hi - lo) + freq - lo AS line, v FROM ms JOIN bd ON freq >= lo AND freq < hi)"""


def granules(spark, sf_dir, short=False):
    """clip, granule and its 576 lines."""
    padded = clips(spark, sf_dir).select("clip", F.concat(F.array_repeat(F.lit(0.0), H.BEFORE), "samples").alias("s"))
    two = padded.withColumn("granule", F.explode(F.sequence(F.lit(0), F.lit(1))))
    framed = two.select("clip", F.col("granule").cast("long").alias("granule"), F.slice("s", F.col("granule") * H.GRANULE + 1, H.BEFORE + H.GRANULE).alias("s"))
    return spectra.transform(framed, "s", H.granule_matrix(H.low_pass(), short), "lines").drop("s")


def _slots(spark, sf_dir):
    parts = clips(spark, sf_dir).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(35))))
    parts = parts.select("clip", F.col("slot").cast("long").alias("slot"), F.slice("samples", F.col("slot") * 32 + 1, 32).alias("s"))
    return spectra.transform(parts, "s", H.cosine_matrix(), "subbands").drop("s")


def _subbands(spark, sf_dir):
    """clip, subband and its 36 samples in order of slot."""
    long = _slots(spark, sf_dir).select("clip", "slot", F.posexplode("subbands").alias("subband", "v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"])
    return long.groupBy("clip", F.col("subband").cast("long").alias("subband")).agg(ordered.alias("block"))


@query(f"WITH {CLIPS}, {_SLOTS} SELECT clip, slot::BIGINT AS slot, subband::BIGINT AS subband, {rounded('v')} AS value FROM sl")
def subband_block(spark, sf_dir):
    """32 cosine-modulated subbands of each slot of 32 samples, 36 slots in a clip."""
    long = _slots(spark, sf_dir).select("clip", "slot", F.posexplode("subbands").alias("subband", "v"))
    return long.select("clip", "slot", F.col("subband").cast("long").alias("subband"), _r("v").alias("value"))


@query(f"WITH {CLIPS}, {_SLOTS} SELECT clip, subband::BIGINT AS subband, f::BIGINT AS line, {rounded('sum(v * sin(pi() / 36 * (slot + 0.5)) * cos(pi() / 18 * (slot + 0.5 + 9) * (f + 0.5)))')} AS value FROM sl CROSS JOIN (SELECT unnest(range(18)) AS f) GROUP BY clip, subband, f")
def subband_long_lines(spark, sf_dir):
    """The long transform: 36 samples of each subband to 18 lines under the sine window."""
    lines = _subbands(spark, sf_dir).select("clip", "subband", F.posexplode(T.mdct(F.col("block"), 18, T.sine_window(36))).alias("line", "v"))
    return lines.select("clip", "subband", F.col("line").cast("long").alias("line"), _r("v").alias("value"))


@query(f"WITH {CLIPS}, {_SLOTS} SELECT clip, subband::BIGINT AS subband, w::BIGINT AS part, f::BIGINT AS line, {rounded('sum(v * sin(pi() / 12 * (slot - 6 - 6 * w + 0.5)) * cos(pi() / 6 * (slot - 6 - 6 * w + 0.5 + 3) * (f + 0.5)))')} AS value FROM sl JOIN (SELECT unnest(range(3)) AS w) ON slot >= 6 + 6 * w AND slot < 18 + 6 * w CROSS JOIN (SELECT unnest(range(6)) AS f) GROUP BY clip, subband, w, f")
def subband_short_lines(spark, sf_dir):
    """The short transforms: three windows of 12 samples, at hops of six, to six lines each."""
    parts = F.array(*(T.mdct(F.slice("block", 7 + 6 * w, 12), 6, T.sine_window(12)) for w in range(3)))
    lines = _subbands(spark, sf_dir).select("clip", "subband", F.posexplode(parts).alias("part", "lines")).select("*", F.posexplode("lines").alias("line", "v"))
    return lines.select("clip", "subband", F.col("part").cast("long").alias("part"), F.col("line").cast("long").alias("line"), _r("v").alias("value"))


@query(f"WITH {CLIPS}, {_TAPS}, hp AS (SELECT clip, h, t % 64 AS y, sum(c * x) AS v FROM cl JOIN (SELECT h, t, c, 32 * h + 31 - t AS n FROM tp CROSS JOIN (SELECT unnest(range(36)) AS h)) USING (n) GROUP BY clip, h, y) SELECT clip, h::BIGINT AS hop, k::BIGINT AS subband, {rounded('sum(v * cos((2 * k + 1) * (y - 16) * pi() / 64))', 9)} AS value FROM hp CROSS JOIN (SELECT unnest(range(32)) AS k) GROUP BY clip, h, k")
def polyphase_hops(spark, sf_dir):
    """32 subbands of each hop of 32 samples, over 512 taps of a prototype made by rule."""
    padded = clips(spark, sf_dir).select("clip", F.concat(F.array_repeat(F.lit(0.0), H.TAPS - H.BANDS), "samples").alias("s")).withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(35))))
    framed = padded.select("clip", F.col("hop").cast("long").alias("hop"), F.slice("s", F.col("hop") * H.BANDS + 1, H.TAPS).alias("s"))
    found = spectra.transform(framed, "s", H.polyphase_matrix(H.low_pass()), "v").select("clip", "hop", F.posexplode("v").alias("subband", "v"))
    return found.select("clip", "hop", F.col("subband").cast("long").alias("subband"), _r("v", 9).alias("value"))


def _long(found):
    long = found.select("clip", "granule", F.posexplode("lines").alias("line", "v"))
    return long.select("clip", "granule", F.col("line").cast("long").alias("line"), _r("v", 9).alias("value"))


@query(f"WITH {LONG} SELECT clip, g::BIGINT AS granule, line::BIGINT AS line, {rounded('v', 9)} AS value FROM ln")
def hybrid_spectrum(spark, sf_dir):
    """The 576 long lines of each granule: subbands, inversion, transform with the granule before, alias reduction."""
    return _long(granules(spark, sf_dir))


@query(f"WITH {SHORT} SELECT clip, g::BIGINT AS granule, line::BIGINT AS line, {rounded('v', 9)} AS value FROM sh")
def short_spectrum(spark, sf_dir):
    """The 576 short lines of each granule, by band, window and frequency."""
    return _long(granules(spark, sf_dir, short=True))


@query(f"""WITH {SHORT}, q AS (SELECT clip, g, w, band, round(pow(abs(v), 0.75) / 0.002 * pow(2.0::DOUBLE, 0.75 * (0.5 * (band % 4) + 2 * w))) AS m, v FROM sh)
SELECT clip, g::BIGINT AS granule, w::BIGINT AS part, sum(m)::BIGINT AS magnitude, count(CASE WHEN m > 0 THEN 1 END)::BIGINT AS held, sum(CASE WHEN v < 0 THEN -m ELSE m END)::BIGINT AS total, (max(m) <= 8191) AS fits FROM q GROUP BY clip, g, w""")
def short_quantise(spark, sf_dir):
    """Short lines quantised with a gain for each band and window; a line over 8191 rules the step out."""
    places = [(b, w) for b, (lo, hi) in enumerate(zip(H.SHORT_BANDS, H.SHORT_BANDS[1:], strict=False)) for w in range(3) for _ in range(lo, hi)]
    gains = T.constants([2 ** (0.75 * (0.5 * (b % 4) + 2 * w)) for b, w in places])
    q = F.zip_with("lines", gains, lambda x, g: F.struct(F.round(F.pow(F.abs(x), F.lit(0.75)) / 0.002 * g).alias("m"), x.alias("x")))
    windows = F.lit([w for _, w in places])
    long = granules(spark, sf_dir, short=True).select("clip", "granule", F.explode(F.zip_with(q, windows, lambda a, w: F.struct(w.cast("long").alias("part"), a["m"].alias("m"), a["x"].alias("x")))).alias("r")).select("clip", "granule", "r.*")
    m = F.col("m")
    return long.groupBy("clip", "granule", "part").agg(F.sum(m).cast("long").alias("magnitude"), F.count(F.when(m > 0, 1)).alias("held"), F.sum(F.when(F.col("x") < 0, -m).otherwise(m)).cast("long").alias("total"), (F.max(m) <= 8191).alias("fits"))


@query(f"WITH {CLIPS} SELECT clip, k::BIGINT AS line, {rounded('sum(x * sin(pi() / 2048 * (n + 0.5)) * cos(pi() / 1024 * (n + 0.5 + 512) * (k + 0.5)))')} AS value FROM cl CROSS JOIN (SELECT unnest(range(1024)) AS k) GROUP BY clip, k")
def long_frame_lines(spark, sf_dir):
    """A frame of 2048 samples, zero past the clip's end, to 1024 lines under the sine window."""
    framed = clips(spark, sf_dir).select("clip", F.concat("samples", F.array_repeat(F.lit(0.0), 2048 - 1152)).alias("s"))
    lines = spectra.transform(framed, "s", spectra.mdct_matrix(1024, T.sine_window(2048)), "lines").select("clip", F.posexplode("lines").alias("line", "v"))
    return lines.select("clip", F.col("line").cast("long").alias("line"), _r("v").alias("value"))


@query(f"WITH {CLIPS}, d AS (SELECT clip, n // 48 AS frame, k, sum(x * cos(2 * pi() * k * (n % 48) / 48)) AS re, sum(x * sin(2 * pi() * k * (n % 48) / 48)) AS im FROM cl CROSS JOIN (SELECT unnest(range(25)) AS k) GROUP BY clip, frame, k) SELECT clip, frame::BIGINT AS frame, k::BIGINT AS bin, {rounded('re * re + im * im')} AS power FROM d")
def power_spectrum_48(spark, sf_dir):
    """Power spectrum of frames of 48 samples, a size that is no power of two."""
    frames = clips(spark, sf_dir).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("clip", F.col("frame").cast("long").alias("frame"), F.slice("samples", F.col("frame") * 48 + 1, 48).alias("s"))
    bins = frames.select("clip", "frame", F.posexplode(T.power_spectrum(F.col("s"), 48)).alias("bin", "p"))
    return bins.select("clip", "frame", F.col("bin").cast("long").alias("bin"), _r("p").alias("power"))
