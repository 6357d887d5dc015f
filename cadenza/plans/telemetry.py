"""Aggregates over coding decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pcm
from ..operators import codebooks as K
from ..operators import rate as R
from ..sources.adaptors import frame_facts
from .planning import _BANDS, _BEST, _BITLEN, _COST, _LINES, WIDTH, _costs, _long, _quantised
from .quality import _r
from .registry import FRAMES, query, rounded


@query(f"""WITH {_BANDS}, s AS (SELECT block, band, 60 + greatest({_BITLEN.format('top')} - 1, 0) AS sf FROM ba), d AS (SELECT block, sf - 60 AS d FROM s)
SELECT block, count(*)::BIGINT AS bands, sum((d > 0)::INT)::BIGINT AS raised, max(d)::BIGINT AS max_delta, {rounded('avg(d)')} AS mean_delta FROM d GROUP BY block""")
def scale_factor_profile(spark, sf_dir):
    """Bands, those raised over the base, and the largest and mean raise."""
    bands = _long(_quantised(spark, sf_dir)).groupBy("block", F.floor(F.col("line") / WIDTH).alias("band")).agg(F.max(F.abs("q")).alias("top"))
    d = bands.select("block", F.greatest(pcm.bit_length(F.col("top")) - 1, F.lit(0)).alias("d"))
    return d.groupBy("block").agg(F.count("*").alias("bands"), F.sum((F.col("d") > 0).cast("long")).alias("raised"), F.max("d").cast("long").alias("max_delta"), _r(F.avg("d")).alias("mean_delta"))


@query(f"""WITH {_BEST} SELECT block, count(*)::BIGINT AS bands, sum((codebook = 11)::INT)::BIGINT AS escape_bands, sum((codebook = 0)::INT)::BIGINT AS zero_bands, sum(bits)::BIGINT AS bits, sum(CASE WHEN codebook = 11 THEN bits ELSE 0 END)::BIGINT AS escape_bits,
arg_max(band, (bits, -band))::BIGINT AS dominant_band, max(bits)::BIGINT AS dominant_bits FROM be GROUP BY block""")
def payload_breakdown(spark, sf_dir):
    """Bits of a block by class of codebook, and its dearest band, the first of equal ones."""
    best = K.cheapest(_costs(spark, sf_dir), ["block", "band"], "codebook", "bits")
    escape = F.col("codebook") == 11
    out = best.groupBy("block").agg(
        F.count("*").alias("bands"), F.sum(escape.cast("long")).alias("escape_bands"), F.sum((F.col("codebook") == 0).cast("long")).alias("zero_bands"), F.sum("bits").alias("bits"),
        F.sum(F.when(escape, F.col("bits")).otherwise(0)).alias("escape_bits"), F.max(F.struct("bits", (-F.col("band")).alias("n"))).alias("d"),
    )
    return out.select("block", "bands", "escape_bands", "zero_bands", "bits", "escape_bits", (-F.col("d.n")).alias("dominant_band"), F.col("d.bits").alias("dominant_bits"))


@query(f"""WITH {_COST}, r AS (SELECT *, row_number() OVER (PARTITION BY block, band ORDER BY bits, codebook) AS place FROM co)
SELECT block, band::BIGINT AS band, max(CASE WHEN place = 1 THEN codebook END)::BIGINT AS chosen, max(CASE WHEN place = 2 THEN codebook END)::BIGINT AS alternative, (max(CASE WHEN place = 2 THEN bits END) - max(CASE WHEN place = 1 THEN bits END))::BIGINT AS extra_bits FROM r WHERE place <= 2 GROUP BY block, band""")
def codebook_alternatives(spark, sf_dir):
    """The best and the second-best codebook of each band, and what the second would cost more."""
    ranked = _costs(spark, sf_dir).groupBy("block", "band").agg(F.slice(F.array_sort(F.collect_list(F.struct("bits", "codebook"))), 1, 2).alias("r"))
    first, second = F.get("r", 0), F.get("r", 1)
    return ranked.select("block", "band", first["codebook"].alias("chosen"), second["codebook"].alias("alternative"), (second["bits"] - first["bits"]).alias("extra_bits"))


@query(f"""WITH {_LINES}, a AS (SELECT block, sum(abs(c)) AS total, sum(CASE WHEN line < 8 THEN abs(c) ELSE 0 END) AS low, count(CASE WHEN q <> 0 THEN 1 END) AS nonzero, count(CASE WHEN q <> 0 AND line < 8 THEN 1 END) AS low_nonzero FROM (SELECT q.block, q.line, q.c, q.q FROM qu q) GROUP BY block)
SELECT block, {rounded('low / total')} AS low_share, nonzero::BIGINT AS nonzero, low_nonzero::BIGINT AS low_nonzero FROM a""")
def low_band_shape(spark, sf_dir):
    """Share of the lowest eight lines in a block's magnitudes, and non-zero lines there and over all."""
    q = _quantised(spark, sf_dir)
    size = lambda x: pcm.total(x, F.abs)
    nonzero = lambda x: pcm.count_where(x, lambda v: v != 0).cast("long")
    return q.select("block", _r(size(F.slice("lines", 1, 8)) / size(F.col("lines"))).alias("low_share"), nonzero(F.col("q")).alias("nonzero"), nonzero(F.slice("q", 1, 8)).alias("low_nonzero"))


@query(f"""WITH {_LINES}, b AS (SELECT block, line // {WIDTH} AS band, sum(abs(c)) AS s, count(CASE WHEN q <> 0 THEN 1 END) AS n FROM qu GROUP BY block, band) SELECT block, band::BIGINT AS band, {rounded('s / sum(s) OVER (PARTITION BY block)')} AS share, n::BIGINT AS nonzero FROM b""")
def band_shape(spark, sf_dir):
    """Each band's share of its block's magnitudes, and its non-zero lines."""
    q = _quantised(spark, sf_dir).withColumn("all", pcm.total(F.col("lines"), F.abs))
    bands = pcm.each(32 // WIDTH, lambda k: F.struct(pcm.total(F.slice("lines", k * WIDTH + 1, WIDTH), F.abs).alias("s"), pcm.count_where(F.slice("q", k * WIDTH + 1, WIDTH), lambda v: v != 0).cast("long").alias("n")))
    long = q.select("block", "all", F.posexplode(bands).alias("band", "b"))
    return long.select("block", F.col("band").cast("long").alias("band"), _r(F.col("b.s") / F.col("all")).alias("share"), F.col("b.n").alias("nonzero"))


@query(f"""WITH RECURSIVE {FRAMES}, st AS (SELECT stream_id, frame, payload, 200::BIGINT AS budget, 200 - least(payload, 200) AS reservoir_after FROM fr WHERE frame = 0
UNION ALL SELECT fr.stream_id, fr.frame, fr.payload, 200 + least(st.reservoir_after, 511), 200 + least(st.reservoir_after, 511) - least(fr.payload, 200 + least(st.reservoir_after, 511)) FROM st JOIN fr ON fr.stream_id = st.stream_id AND fr.frame = st.frame + 1)
SELECT stream_id, count(*)::BIGINT AS frames, sum((payload > budget)::INT)::BIGINT AS over_budget, max(reservoir_after)::BIGINT AS most_reserved, {rounded('sum(least(payload, budget)) / sum(budget)')} AS utilisation, max(greatest(payload - budget, 0))::BIGINT AS worst_excess FROM st GROUP BY stream_id""")
def reservoir_profile(spark, sf_dir):
    """How each stream used its budgets."""
    frames = frame_facts(spark, sf_dir).select("stream_id", "frame", "payload")
    rows = R.reservoir(frames, "stream_id", "frame", "payload", 200).join(frames, ["stream_id", "frame"])
    return rows.groupBy("stream_id").agg(
        F.count("*").alias("frames"), F.sum(F.col("over").cast("long")).alias("over_budget"), F.max("reservoir_after").alias("most_reserved"),
        _r(F.sum("used") / F.sum("budget")).alias("utilisation"), F.max(F.greatest(F.col("payload") - F.col("budget"), F.lit(0))).cast("long").alias("worst_excess"),
    )


@query(f"""WITH {FRAMES} SELECT (payload // 50)::BIGINT AS size_class, count(*)::BIGINT AS frames, sum(payload)::BIGINT AS bytes, max(payload)::BIGINT AS largest, {rounded('avg(payload)')} AS mean, {rounded('avg(discount)')} AS mean_step FROM fr GROUP BY 1""")
def frame_profile(spark, sf_dir):
    """Frames by class of payload size."""
    f = frame_facts(spark, sf_dir).groupBy(F.floor(F.col("payload") / 50).alias("size_class"))
    return f.agg(F.count("*").alias("frames"), F.sum("payload").alias("bytes"), F.max("payload").alias("largest"), _r(F.avg("payload")).alias("mean"), _r(F.avg("discount")).alias("mean_step"))


@query(f"""WITH {FRAMES}, g(gain) AS (VALUES (-2), (-1), (0), (1), (2)), b(bias) AS (VALUES (0), (1), (2)), c AS (SELECT stream_id, gain, bias, max(payload + gain * 16 - bias * 8) AS top, min(400 - (payload + gain * 16 - bias * 8)) AS slack FROM fr CROSS JOIN g CROSS JOIN b GROUP BY ALL)
SELECT stream_id, count(*)::BIGINT AS candidates, min(slack)::BIGINT AS least_slack, max(top)::BIGINT AS largest FROM c WHERE slack >= 0 AND top <= 390 GROUP BY stream_id""")
def control_candidates(spark, sf_dir):
    """Of fifteen gains and biases, those that keep every frame of a stream within bounds."""
    s = frame_facts(spark, sf_dir).groupBy("stream_id").agg(F.max("payload").alias("top"))
    options = F.explode(F.array(*(F.lit(g * 16 - b * 8) for g in (-2, -1, 0, 1, 2) for b in (0, 1, 2))))
    c = s.select("stream_id", "top", options.alias("shift")).select("stream_id", (F.col("top") + F.col("shift")).alias("top")).where("top <= 390")
    return c.groupBy("stream_id").agg(F.count("*").alias("candidates"), F.min(400 - F.col("top")).cast("long").alias("least_slack"), F.max("top").cast("long").alias("largest"))
