"""Sample shape, comparison and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pcm
from ..operators import compare
from ..sources.adaptors import pcm_blocks, read, stereo_blocks
from .registry import PX, STEREO, query, rounded


def _r(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


Q16 = "(CASE WHEN x <= -1 THEN -32768 ELSE round(least(greatest(x, -1.0::DOUBLE), 1.0::DOUBLE) * 32767) END)"
D16 = "(CASE WHEN q < 0 THEN q / 32768.0::DOUBLE ELSE q / 32767.0::DOUBLE END)"


@query(f"""WITH {PX}, a AS (SELECT *, {Q16} AS q FROM px), b AS (SELECT *, {D16} AS y FROM a)
SELECT stream_id, count(*)::BIGINT AS n, {rounded('max(abs(x - y))', 9)} AS max_abs, {rounded('sqrt(sum((x - y) * (x - y)) / count(*))', 9)} AS rms,
  {rounded('10 * log10(sum(x * x) / sum((x - y) * (x - y)))', 4)} AS snr_db FROM b GROUP BY stream_id""")
def pcm_quality(spark, sf_dir):
    """16-bit quantisation of every stream, against the original."""
    samples = pcm_blocks(spark, sf_dir).select("stream_id", F.explode("samples").alias("x"))
    back = samples.withColumn("y", pcm.denormalise(pcm.quantise(F.col("x"), 16), 16))
    diff = compare.difference(back, "x", "y", "stream_id")
    return diff.select("stream_id", "n", _r("max_abs", 9).alias("max_abs"), _r("rms", 9).alias("rms"), _r("snr_db", 4).alias("snr_db"))


@query(f"""WITH {PX}, k AS (SELECT unnest(range(16)) AS k), b AS (SELECT DISTINCT block FROM px)
SELECT b.block, k.k::BIGINT AS frame, coalesce(px.x, 0.0) AS value FROM b CROSS JOIN k LEFT JOIN px ON px.block = b.block AND px.i = (k.k + 24) * 2 + 1""")
def pcm_channel_block(spark, sf_dir):
    """Sixteen frames of the second channel from frame 24 on, zero past the end, of blocks read as interleaved stereo."""
    blocks = pcm_blocks(spark, sf_dir)
    return blocks.select("block", F.posexplode(pcm.channel_block(F.col("samples"), 2, 1, 24, 16)).alias("frame", "value")).withColumn("frame", F.col("frame").cast("long"))


@query(f"""WITH {PX}, a AS (SELECT *, {Q16} AS q FROM px) SELECT q::BIGINT AS q, count(*)::BIGINT AS n, {rounded(f'max({D16})', 12)} AS value FROM a GROUP BY q""")
def pcm_denormalise(spark, sf_dir):
    """The 16-bit values in use, how often, and the sample each decodes to."""
    q = pcm_blocks(spark, sf_dir).select(F.explode("samples").alias("x")).groupBy(pcm.quantise(F.col("x"), 16).alias("q")).agg(F.count("*").alias("n"))
    return q.select("q", "n", _r(pcm.denormalise(F.col("q"), 16), 12).alias("value"))


@query(f"""WITH {PX}, a AS (SELECT *, round(x * 127) / 127.0::DOUBLE AS y FROM px),
d AS (SELECT block, max(abs(x - y)) AS m, sqrt(sum((x - y) * (x - y)) / count(*)) AS r, 10 * log10(sum(x * x) / sum((x - y) * (x - y))) AS s FROM a GROUP BY block)
SELECT block, CASE WHEN m > 0.00392 THEN 'max_abs' WHEN r > 0.0023 THEN 'rms' WHEN s < 34.7 THEN 'snr_db' ELSE 'pass' END AS verdict FROM d""")
def tolerance_gate(spark, sf_dir):
    """Verdict on 8-bit quantisation of each block: the first bound that fails."""
    blocks = pcm_blocks(spark, sf_dir).withColumn("y", F.transform("samples", lambda x: F.round(x * 127) / 127.0))
    diff = blocks.withColumn("d", compare.array_difference(F.col("samples"), F.col("y")))
    return diff.select("block", compare.verdict(F.col("d"), compare.Tolerance(0.00392, 0.0023, 34.7)).alias("verdict"))


@query(f"WITH {STEREO} SELECT pair, {rounded('sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r)))')} AS corr FROM st GROUP BY pair")
def channel_correlation(spark, sf_dir):
    """Normalised correlation of left and right."""
    return stereo_blocks(spark, sf_dir).select("pair", _r(compare.correlation(F.col("left"), F.col("right"))).alias("corr"))


@query(f"""WITH {STEREO}, k AS (SELECT unnest(range(12)) AS lag),
c AS (SELECT a.pair, k.lag, round(sum(a.l * b.r) / (sqrt(sum(a.l * a.l)) * sqrt(sum(b.r * b.r))), 9) AS corr FROM st a CROSS JOIN k JOIN st b ON b.pair = a.pair AND b.i = a.i + k.lag GROUP BY a.pair, k.lag)
SELECT pair, arg_max(lag, (corr, -lag))::BIGINT AS lag, {rounded('max(corr)')} AS corr FROM c GROUP BY pair""")
def best_lag(spark, sf_dir):
    """The delay of right against left, of 0 to 11 samples, with the highest correlation."""
    found = stereo_blocks(spark, sf_dir).select("pair", compare.best_lag(F.col("left"), F.col("right"), 64, 12).alias("b"))
    return found.select("pair", "b.lag", _r("b.corr").alias("corr"))


@query(f"""WITH {STEREO}, g AS (SELECT pair, sqrt(avg(l * l)) AS a, sqrt(avg(r * r)) AS b, sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r))) AS c FROM st GROUP BY pair)
SELECT pair, {rounded('b / a')} AS level, (b / a BETWEEN 0.05 AND 32 AND c >= 0.2) AS accepted FROM g""")
def quality_gate(spark, sf_dir):
    """Level ratio of right to left, and whether right passes as a decoding of left."""
    rms = lambda c: F.sqrt(pcm.total(F.col(c), lambda x: x * x) / F.size(c))
    both = stereo_blocks(spark, sf_dir).select("pair", rms("left").alias("a"), rms("right").alias("b"), compare.correlation(F.col("left"), F.col("right")).alias("c"))
    return both.select("pair", _r(F.col("b") / F.col("a")).alias("level"), compare.quality_gate(F.col("a"), F.col("b"), F.col("c")).alias("accepted"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents")
def payload_md5(spark, sf_dir):
    """MD5 of every text's bytes."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("md5"), F.octet_length(text).cast("long").alias("n_bytes"))


def _medians(size: int) -> str:
    return f"""WITH {PX}, v AS (SELECT block, i // {size} AS part, x, row_number() OVER (PARTITION BY block, i // {size} ORDER BY x) AS k, count(*) OVER (PARTITION BY block, i // {size}) AS n FROM px)
SELECT block, part::BIGINT AS part, {rounded('max(CASE WHEN k = (n + 1) // 2 THEN x END)')} AS median FROM v GROUP BY block, part"""


def _median(spark, sf_dir, size):
    """Of what is left at the end, the lower of the two in the middle."""
    parts = pcm.each(-(-64 // size), lambda k: pcm.let(F.array_sort(F.slice("samples", k * size + 1, size)), lambda p: F.get(p, F.floor((F.size(p) - 1) / 2).cast("int"))))
    found = pcm_blocks(spark, sf_dir).select("block", F.posexplode(parts).alias("part", "median"))
    return found.select("block", F.col("part").cast("long").alias("part"), _r("median").alias("median"))


@query(_medians(5))
def median_of_five(spark, sf_dir):
    """Medians of consecutive five samples."""
    return _median(spark, sf_dir, 5)


@query(_medians(3))
def median_of_three(spark, sf_dir):
    """Medians of consecutive three samples."""
    return _median(spark, sf_dir, 3)
