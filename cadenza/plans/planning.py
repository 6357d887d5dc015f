"""Quantisation, scale factors, sections and the choice of codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import pcm
from ..functions import transforms as T
from ..operators import codebooks as K
from ..sources.adaptors import pcm_blocks, read
from .quality import Q16, _r
from .registry import PX, query, rounded

STEP = 0.05
BOOKS = ((1, 1), (5, 4), (7, 7), (9, 12), (11, 16))
WIDTH = 4
#: Lines of the sine-window transform, times a constant, and their quantised values.
_LINES = f"""{PX}, kk AS (SELECT unnest(range(32)) AS line), li AS (SELECT block, line, 8 * sum(x * sin(pi() / 64 * (i + 0.5)) * cos(pi() / 32 * (i + 0.5 + 16) * (line + 0.5))) AS c FROM px CROSS JOIN kk GROUP BY block, line),
qu AS (SELECT block, line, c, (sign(c) * round(pow(abs(c), 0.75) / 0.4))::BIGINT AS q FROM li)"""


def _lines(spark, sf_dir):
    return pcm_blocks(spark, sf_dir).select("block", F.transform(T.mdct(F.col("samples"), 32, T.sine_window(64)), lambda c: 8 * c).alias("lines"))


def _quantised(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("q", F.transform("lines", lambda c: C.power_quantise(c, 0.4)))


def _long(df, value="q"):
    return df.select("block", F.posexplode(value).alias("line", "q")).withColumn("line", F.col("line").cast("long"))


@query(f"WITH {PX} SELECT block, i, (sign(x) * round(pow(abs(x), 0.75) / {STEP}))::BIGINT AS q FROM px")
def power_quantise(spark, sf_dir):
    """sign(x) round(|x|^(3/4) / step)."""
    q = pcm_blocks(spark, sf_dir).select("block", F.posexplode(F.transform("samples", lambda x: C.power_quantise(x, STEP))).alias("i", "q"))
    return q.withColumn("i", F.col("i").cast("long"))


@query(f"WITH {PX} SELECT block, i, (sign(x) * round(pow(abs(x), 0.75) * pow(2.0, 0.75 * 0.5 * (i // 16)) / {STEP}))::BIGINT AS q FROM px")
def scaled_quantise(spark, sf_dir):
    """The same after the gain of each band of 16 samples' scale factor, here its index."""
    q = pcm_blocks(spark, sf_dir).select("block", F.posexplode(F.transform("samples", lambda x, i: C.scaled_quantise(x, STEP, F.floor(i / 16)))).alias("i", "q"))
    return q.withColumn("i", F.col("i").cast("long"))


@query(f"WITH {PX}, q AS (SELECT block, x, sign(x) * round(pow(abs(x), 0.75) / {STEP}) AS q FROM px) SELECT block, {rounded(f'max(abs(x - sign(q) * pow(abs(q) * {STEP}, 4.0 / 3)))')} AS worst, {rounded('sum(sign(q) * pow(abs(q), 4.0 / 3) * pow(2.0, -2.5))')} AS total FROM q GROUP BY block")
def requantise(spark, sf_dir):
    """Worst error of the quantiser's inverse, and the sum of requantised values at gain 200."""
    q = pcm_blocks(spark, sf_dir).withColumn("q", F.transform("samples", lambda x: C.power_quantise(x, STEP)))
    back = F.transform("q", lambda v: F.signum(v.cast("double")) * F.pow(F.abs(v) * STEP, F.lit(4.0 / 3)))
    return q.select("block", _r(pcm.max_abs(F.zip_with("samples", back, lambda a, b: a - b))).alias("worst"), _r(pcm.total(F.transform("q", lambda v: C.requantise(v, F.lit(200))))).alias("total"))


@query("""SELECT l_partkey AS part, l_linenumber::BIGINT AS line, count(*)::BIGINT AS n, max(CASE WHEN l_tax > 0 THEN greatest(least(round(210 + 16.0 / 3 * log2(l_tax)), 255), 0) ELSE 210 END)::BIGINT AS gain,
max(CASE WHEN l_tax > 0 THEN greatest(least(round(210 + 16.0 / 3 * log2(l_tax) - 4 * log2(9)), 255), 0) ELSE 210 END)::BIGINT AS calibrated, max(CASE WHEN l_tax > 0 AND round(164 + 16.0 / 3 * log2(l_tax)) BETWEEN 0 AND 255 THEN round(164 + 16.0 / 3 * log2(l_tax)) END)::BIGINT AS scale_factor FROM lineitem GROUP BY 1, 2""")
def step_gains(spark, sf_dir):
    """Gains and scale factors of steps (the taxes of order lines)."""
    step = F.col("l_tax")
    agg = [F.max(x).alias(n) for x, n in ((C.global_gain(step), "gain"), (C.global_gain(step, calibrated=True), "calibrated"), (C.uniform_scale_factor(step), "scale_factor"))]
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("long").alias("line")).agg(F.count("*").alias("n"), *agg)


_BITLEN = "CASE WHEN {0} <= 0 THEN 0 ELSE length(bin({0}::BIGINT)) END"
_BANDS = f"""{_LINES}, ba AS (SELECT block, line // {WIDTH} AS band, max(abs(q)) AS top FROM qu GROUP BY block, band)"""


@query(f"WITH {_BANDS} SELECT block, band::BIGINT AS band, (60 + greatest({_BITLEN.format('top')} - 1, 0))::BIGINT AS scale_factor FROM ba")
def band_scale_factors(spark, sf_dir):
    """Base plus what the band's largest magnitude has in bits over a bias of one."""
    bands = _long(_quantised(spark, sf_dir)).groupBy("block", F.floor(F.col("line") / WIDTH).alias("band")).agg(F.max(F.abs("q")).alias("top"))
    return bands.select("block", "band", (60 + F.greatest(pcm.bit_length(F.col("top")) - 1, F.lit(0))).cast("long").alias("scale_factor"))


@query(f"""WITH {_BANDS}, s AS (SELECT block, band, 60 + greatest({_BITLEN.format('top')} - 1, 0) AS sf FROM ba WHERE top > 0)
SELECT block, band::BIGINT AS band, (sf - coalesce(lag(sf) OVER (PARTITION BY block ORDER BY band), 60))::BIGINT AS delta FROM s""")
def scale_factor_deltas(spark, sf_dir):
    """Differences of scale factors from band to band, bands of zeros left out."""
    bands = _long(_quantised(spark, sf_dir)).groupBy("block", F.floor(F.col("line") / WIDTH).alias("band")).agg(F.max(F.abs("q")).alias("top")).where("top > 0")
    sf = 60 + F.greatest(pcm.bit_length(F.col("top")) - 1, F.lit(0))
    before = F.coalesce(F.lag(sf).over(Window.partitionBy("block").orderBy("band")), F.lit(60))
    return bands.select("block", "band", (sf - before).cast("long").alias("delta"))


@query(f"""WITH {PX}, q AS (SELECT block, i, (sign(x) * round(pow(abs(x), 0.75) / 0.2))::BIGINT AS q FROM px), l AS (SELECT block, coalesce(max(CASE WHEN q <> 0 THEN i + 1 END), 0) AS last FROM q GROUP BY block),
b AS (SELECT l.block, last, coalesce(min(CASE WHEN i < last AND abs(q) > 1 THEN last - 1 - i END), last) // 4 AS quads FROM l JOIN q USING (block) GROUP BY l.block, last)
SELECT block, ceil((last - 4 * quads) / 2.0)::BIGINT AS big_pairs, quads::BIGINT AS count1_quads, (64 - last)::BIGINT AS zero_lines FROM b""")
def spectral_regions(spark, sf_dir):
    """Pairs, quads and zeros of the quantised samples."""
    q = pcm_blocks(spark, sf_dir).withColumn("q", F.transform("samples", lambda x: C.power_quantise(x, 0.2)))
    return q.select("block", K.spectral_regions(F.col("q")).alias("r")).select("block", "r.*")


@query(f"WITH {_BANDS} SELECT block, band::BIGINT AS band, top::BIGINT AS top, (CASE WHEN top = 0 THEN 0 WHEN top <= 7 THEN 7 WHEN top <= 12 THEN 9 WHEN top <= 8191 THEN 11 END)::BIGINT AS class, (CASE WHEN top <= 0 THEN 0 WHEN top <= 1 THEN 1 WHEN top <= 3 THEN 5 WHEN top <= 5 THEN 7 WHEN top <= 7 THEN 10 WHEN top <= 15 THEN 13 ELSE 16 END)::BIGINT AS table_class FROM ba")
def magnitude_classes(spark, sf_dir):
    """Classes of bands by their largest magnitude."""
    bands = _long(_quantised(spark, sf_dir)).groupBy("block", F.floor(F.col("line") / WIDTH).alias("band")).agg(F.max(F.abs("q")).alias("top"))
    return bands.select("block", "band", "top", C.band_class(F.col("top")).alias("class"), C.magnitude_class(F.col("top")).alias("table_class"))


_BOOK_ROWS = ", ".join(f"({b}, {m})" for b, m in BOOKS)
_COST = f"""{_LINES}, bk(codebook, most) AS (VALUES {_BOOK_ROWS}),
pr AS (SELECT a.block, a.line // {WIDTH} AS band, abs(a.q) AS x, abs(b.q) AS y FROM qu a JOIN qu b ON b.block = a.block AND b.line = a.line + 1 WHERE a.line % 2 = 0),
mx AS (SELECT block, band, max(greatest(x, y)) AS top FROM pr GROUP BY block, band),
es AS (SELECT block, band, x, y, least(x, 16) AS cx, least(y, 16) AS cy, (CASE WHEN x >= 16 THEN 2 * (length(bin(x)) - 1) - 3 ELSE 0 END) + (CASE WHEN y >= 16 THEN 2 * (length(bin(y)) - 1) - 3 ELSE 0 END) AS esc FROM pr),
co AS (SELECT es.block, es.band, codebook, sum(1 + 2 * ({_BITLEN.format('cx')} + {_BITLEN.format('cy')}) + {_BITLEN.format('most')} + (x <> 0)::INT + (y <> 0)::INT + esc)::BIGINT AS bits FROM es JOIN mx USING (block, band) JOIN bk ON bk.most >= least(top, 16) WHERE top > 0 GROUP BY es.block, es.band, codebook
UNION ALL SELECT block, band, 0, 0 FROM mx WHERE top = 0)"""


def _costs(spark, sf_dir):
    """Bits of every band under every codebook that can hold it; a band of zeros has codebook 0 and no bits."""
    table = F.broadcast(K.pair_codebook(spark, BOOKS))  # of fixed size
    pairs = _quantised(spark, sf_dir).select("block", F.explode(pcm.each(16, lambda k: F.struct(F.floor(k * 2 / WIDTH).alias("band"), F.abs(F.get("q", 2 * k)).alias("a"), F.abs(F.get("q", 2 * k + 1)).alias("b")))).alias("p")).select("block", "p.*")
    capped = pairs.withColumns({"x": F.least("a", F.lit(16)), "y": F.least("b", F.lit(16))})
    signs = (F.col("a") != 0).cast("long") + (F.col("b") != 0).cast("long")
    bits = F.col("bits") + signs + C.escape_bits(F.col("a")) + C.escape_bits(F.col("b"))
    costs = capped.join(table, ["x", "y"]).groupBy("block", "band", "codebook").agg(F.sum(bits).alias("bits"), F.count("*").alias("n"), F.max(F.greatest("a", "b")).alias("top"))
    whole = costs.where((F.col("n") == WIDTH // 2) & (F.col("top") > 0)).select("block", "band", "codebook", "bits")
    zero = costs.where((F.col("n") == WIDTH // 2) & (F.col("top") == 0)).select("block", "band", F.lit(0).cast("long").alias("codebook"), F.lit(0).cast("long").alias("bits")).distinct()
    return whole.unionByName(zero)


@query(f"WITH {_COST} SELECT block, band::BIGINT AS band, codebook::BIGINT AS codebook, bits FROM co")
def codebook_costs(spark, sf_dir):
    return _costs(spark, sf_dir)


_BEST = f"{_COST}, be AS (SELECT block, band, arg_min(codebook, (bits, codebook)) AS codebook, min(bits) AS bits FROM co GROUP BY block, band)"


@query(f"WITH {_BEST} SELECT block, band::BIGINT AS band, codebook::BIGINT AS codebook, bits FROM be")
def cheapest_codebook(spark, sf_dir):
    """The codebook of fewest bits for each band, the first of equal ones."""
    return K.cheapest(_costs(spark, sf_dir), ["block", "band"], "codebook", "bits")


@query(f"""WITH {_BEST}, g AS (SELECT *, band - row_number() OVER (PARTITION BY block, codebook ORDER BY band) AS island FROM be), s AS (SELECT block, codebook, min(band) AS lo, max(band) AS hi, sum(bits) AS bits FROM g GROUP BY block, codebook, island)
SELECT block, (row_number() OVER (PARTITION BY block ORDER BY lo) - 1)::BIGINT AS section, codebook::BIGINT AS codebook, (lo * {WIDTH})::BIGINT AS line_start, ((hi + 1) * {WIDTH})::BIGINT AS line_end, bits::BIGINT AS bits, (4 + 5 * ((hi - lo + 1) // 31 + 1))::BIGINT AS header_bits FROM s""")
def section_plan(spark, sf_dir):
    """Neighbouring bands of one codebook as sections."""
    best = K.cheapest(_costs(spark, sf_dir), ["block", "band"], "codebook", "bits")
    best = best.withColumns({"s": F.col("band") * WIDTH, "e": (F.col("band") + 1) * WIDTH})
    sections = K.merge_sections(best, ["block"], "band", "codebook", "s", "e", "bits")
    header = C.section_header_bits((F.col("line_end") - F.col("line_start")) / WIDTH)
    return sections.select("block", "section", "codebook", "line_start", "line_end", "bits", header.alias("header_bits"))


#: Bits of the escape value that the two families of tables allow; fixed values of the format.
LINBITS = {16: 1, 17: 2, 18: 3, 19: 4, 20: 6, 21: 8, 22: 10, 23: 13, 24: 4, 25: 5, 26: 6, 27: 7, 28: 8, 29: 9, 30: 11, 31: 13}
_LINBITS = ", ".join(f"({t}, {b})" for t, b in LINBITS.items())


@query(f"""WITH t(tbl, linbits) AS (VALUES {_LINBITS}), m AS (SELECT l_orderkey AS stream_id, max(l_quantity * 20)::BIGINT AS top FROM lineitem GROUP BY 1)
SELECT stream_id, top, min(CASE WHEN tbl < 24 THEN tbl END)::BIGINT AS low_table, min(CASE WHEN tbl >= 24 THEN tbl END)::BIGINT AS high_table FROM m JOIN t ON top - 15 <= (1 << linbits) - 1 WHERE top >= 15 GROUP BY stream_id, top""")
def escape_tables(spark, sf_dir):
    """The first table of either family whose escape value is wide enough."""
    table = F.broadcast(spark.createDataFrame(list(LINBITS.items()), "tbl long, linbits int"))
    tops = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stream_id")).agg(F.max(F.col("l_quantity") * 20).cast("long").alias("top")).where("top >= 15")
    fits = tops.join(table, F.expr("top - 15 <= shiftleft(1, linbits) - 1"))
    pick = lambda c: F.min(F.when(c, F.col("tbl")))
    return fits.groupBy("stream_id", "top").agg(pick(F.col("tbl") < 24).alias("low_table"), pick(F.col("tbl") >= 24).alias("high_table"))


_Q = f"{PX}, q0 AS (SELECT block, i, {Q16}::BIGINT AS q FROM px)"
_DIFFS = f"""{_Q}, d1 AS (SELECT block, i, q - lag(q) OVER w AS d FROM q0 WINDOW w AS (PARTITION BY block ORDER BY i)), d2 AS (SELECT block, i, d - lag(d) OVER w AS d FROM d1 WINDOW w AS (PARTITION BY block ORDER BY i)),
d3 AS (SELECT block, i, d - lag(d) OVER w AS d FROM d2 WINDOW w AS (PARTITION BY block ORDER BY i)), d4 AS (SELECT block, i, d - lag(d) OVER w AS d FROM d3 WINDOW w AS (PARTITION BY block ORDER BY i)),
dd AS (SELECT 1 AS o, block, i, d FROM d1 UNION ALL SELECT 2, block, i, d FROM d2 UNION ALL SELECT 3, block, i, d FROM d3 UNION ALL SELECT 4, block, i, d FROM d4),
fo AS (SELECT o, block, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS f FROM dd WHERE d IS NOT NULL)"""


@query(f"WITH {_DIFFS} SELECT block, o::BIGINT AS predictor, sum(f)::BIGINT AS folded FROM fo GROUP BY block, o")
def fixed_residuals(spark, sf_dir):
    """Folded residuals of the fixed predictors, summed."""
    q = pcm_blocks(spark, sf_dir).withColumn("q", F.transform("samples", lambda x: pcm.quantise(x, 16)))
    sums = F.array(*(F.aggregate(F.transform(pcm.difference(F.col("q"), o), pcm.fold_sign), F.lit(0).cast("long"), lambda s, x: s + x) for o in range(1, 5)))
    long = q.select("block", F.posexplode(sums).alias("p", "folded"))
    return long.select("block", (F.col("p") + 1).cast("long").alias("predictor"), "folded")


_RICE = f"""{_DIFFS}, kr AS (SELECT unnest(range(15)) AS k), rc AS (SELECT block, o, k, 8 + o * 16 + 10 + sum(f >> k) + count(*) * (1 + k) AS bits FROM fo CROSS JOIN kr GROUP BY block, o, k),
ri AS (SELECT block, min(bits) AS bits, arg_min(o, (bits, o, k)) AS o, arg_min(k, (bits, o, k)) AS k FROM rc GROUP BY block)"""


@query(f"WITH {_RICE} SELECT block, bits::BIGINT AS bits, o::BIGINT AS predictor, k::BIGINT AS k FROM ri")
def rice_search(spark, sf_dir):
    """The cheapest of four predictors and fifteen Rice parameters."""
    q = pcm_blocks(spark, sf_dir).select("block", F.transform("samples", lambda x: pcm.quantise(x, 16)).alias("q"))
    return q.select("block", K.rice_choice(F.col("q"), 64, 16).alias("r")).select("block", "r.bits", F.col("r.order").alias("predictor"), "r.k")


@query(f"""WITH {_RICE}, u AS (SELECT block, min(q) = max(q) AS same FROM q0 GROUP BY block)
SELECT block, CASE WHEN same THEN 'constant' WHEN bits < 8 + 64 * 16 THEN 'fixed' ELSE 'verbatim' END AS kind, (CASE WHEN same THEN 8 + 16 WHEN bits < 8 + 64 * 16 THEN bits ELSE 8 + 64 * 16 END)::BIGINT AS bits FROM ri JOIN u USING (block)""")
def subframe_choice(spark, sf_dir):
    """Constant, else fixed where it is smaller than verbatim, else verbatim."""
    q = pcm_blocks(spark, sf_dir).select("block", F.transform("samples", lambda x: pcm.quantise(x, 16)).alias("q"))
    q = q.withColumn("fixed", K.rice_choice(F.col("q"), 64, 16)["bits"]).withColumn("same", F.array_min("q") == F.array_max("q"))
    verbatim = 8 + 64 * 16
    kind = F.when(F.col("same"), "constant").when(F.col("fixed") < verbatim, "fixed").otherwise("verbatim")
    bits = F.when(F.col("same"), 8 + 16).otherwise(F.least("fixed", F.lit(verbatim)))
    return q.select("block", kind.alias("kind"), bits.cast("long").alias("bits"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT vec_id AS entry, x, i FROM e WHERE vec_id < 16),
d AS (SELECT e.vec_id AS block, entry, round(sum((e.x - c.x) * (e.x - c.x)), 9) AS d FROM e JOIN c USING (i) GROUP BY e.vec_id, entry) SELECT block, arg_min(entry, (d, entry))::BIGINT AS entry FROM d GROUP BY block""")
def nearest_entry(spark, sf_dir):
    """Vector quantisation with the first 16 blocks as entries (a codebook of fixed size)."""
    blocks = pcm_blocks(spark, sf_dir)
    held = blocks.where("block < 16").agg(F.sort_array(F.collect_list(F.struct("block", "samples"))).alias("held"))
    entries = held.select("held.samples").scalar()  # one row, joined to the plan as a subquery
    return blocks.withColumn("entries", entries).select("block", K.nearest(F.col("samples"), F.col("entries")).alias("entry"))


@query(f"""WITH {PX}, p AS (SELECT block, i // 8 AS part, max(abs(x)) AS top, sum(x * x) AS e FROM px GROUP BY block, part)
SELECT block, part::BIGINT AS part, (CASE WHEN top < 0.1 THEN 0 WHEN top < 0.2 AND e < 0.05 THEN 1 WHEN top < 0.3 THEN 2 ELSE 3 END)::BIGINT AS class FROM p""")
def residue_classes(spark, sf_dir):
    """Classes of partitions of eight samples by largest magnitude and energy."""
    parts = pcm.each(8, lambda k: F.slice("samples", k * 8 + 1, 8))
    p = pcm_blocks(spark, sf_dir).select("block", F.posexplode(parts).alias("part", "s")).select("block", F.col("part").cast("long").alias("part"), pcm.max_abs(F.col("s")).alias("top"), pcm.total(F.col("s"), lambda x: x * x).alias("e"))
    kind = F.when(F.col("top") < 0.1, 0).when((F.col("top") < 0.2) & (F.col("e") < 0.05), 1).when(F.col("top") < 0.3, 2).otherwise(3)
    return p.select("block", "part", kind.cast("long").alias("class"))


@query(f"""WITH {PX}, b(band, lo, hi) AS (VALUES (0, 0, 4), (1, 4, 8), (2, 8, 16), (3, 16, 32), (4, 32, 64)) SELECT block, band::BIGINT AS band, {rounded('sqrt(1e-27 + sum(x * x))')} AS amplitude, {rounded('log2(sqrt(1e-27 + sum(x * x)))')} AS log_amplitude FROM px JOIN b ON i >= lo AND i < hi GROUP BY block, band""")
def band_energy(spark, sf_dir):
    """Amplitudes of bands and their logarithms."""
    bands = F.array(*(F.sqrt(1e-27 + pcm.total(F.slice("samples", a + 1, b - a), lambda x: x * x)) for a, b in ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64))))
    long = pcm_blocks(spark, sf_dir).select("block", F.posexplode(bands).alias("band", "a"))
    return long.select("block", F.col("band").cast("long").alias("band"), _r("a").alias("amplitude"), _r(F.log2("a")).alias("log_amplitude"))


@query(f"""WITH {PX}, q AS (SELECT block, i // 2 AS k, (max(CASE WHEN i % 2 = 0 THEN round(x * 100) END) * 1)::BIGINT AS a, (max(CASE WHEN i % 2 = 1 THEN round(x * 100) END))::BIGINT AS b FROM px GROUP BY block, k)
SELECT block, k::BIGINT AS x, (a + sign(b - a) * (abs(b - a) // 2))::BIGINT AS y FROM q""")
def floor_midpoints(spark, sf_dir):
    """Integer midpoints of floor segments, rounded towards their beginnings, rising or falling."""
    q = F.transform("samples", lambda x: F.round(x * 100).cast("long"))
    segments = pcm.each(32, lambda k: F.struct(F.get("q", 2 * k).alias("a"), F.get("q", 2 * k + 1).alias("b")))
    long = pcm_blocks(spark, sf_dir).withColumn("q", q).select("block", F.posexplode(segments).alias("x", "s"))
    rise = F.col("s.b") - F.col("s.a")
    return long.select("block", F.col("x").cast("long").alias("x"), (F.col("s.a") + F.signum(rise) * F.floor(F.abs(rise) / 2)).cast("long").alias("y"))


# A heap holds (count, number, symbols below); each step joins its two least nodes, which makes all symbols below them a bit longer.
@query(f"""WITH RECURSIVE {PX}, h AS (SELECT stream_id, (sign(x) * round(pow(abs(x), 0.75) / {STEP}))::BIGINT AS symbol, count(*)::BIGINT AS n FROM px GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY symbol) - 1)::BIGINT AS place, count(*) OVER (PARTITION BY stream_id) AS size FROM h),
t AS (SELECT stream_id, any_value(size) AS fresh, list_sort(list({{'n': n, 'id': place, 'below': [symbol]}})) AS heap, NULL::BIGINT[] AS longer FROM r GROUP BY stream_id UNION ALL
SELECT stream_id, fresh + 1, list_sort(list_append(heap[3:], {{'n': heap[1].n + heap[2].n, 'id': fresh, 'below': list_concat(heap[1].below, heap[2].below)}})), list_concat(heap[1].below, heap[2].below) FROM t WHERE len(heap) > 1),
d AS (SELECT stream_id, symbol, count(*)::BIGINT AS length FROM (SELECT stream_id, unnest(longer) AS symbol FROM t) GROUP BY 1, 2),
e AS (SELECT stream_id, symbol, n, coalesce(length, 1)::BIGINT AS length FROM r LEFT JOIN d USING (stream_id, symbol))
SELECT stream_id, symbol, n, length, (coalesce(sum(pow(2.0, -length)) OVER (PARTITION BY stream_id ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0, length))::BIGINT AS code FROM e""")
def huffman_book(spark, sf_dir):
    """Huffman lengths and canonical codes of the quantised samples of each stream."""
    q = pcm_blocks(spark, sf_dir).select("stream_id", F.explode(F.transform("samples", lambda x: C.power_quantise(x, STEP))).alias("symbol"))
    return K.huffman_table(q.groupBy("stream_id", "symbol").agg(F.count("*").alias("n")), ["stream_id"], "symbol", "n")


@query(f"""WITH {PX}, q AS (SELECT block, i, {Q16}::BIGINT AS q FROM px), b AS (SELECT block, string_agg(lpad(bin(CASE WHEN q < 0 THEN -2 * q - 1 ELSE 2 * q END), 17, '0'), '' ORDER BY i) AS bits FROM q GROUP BY block)
SELECT block, bits, strlen(bits)::BIGINT AS bit_len FROM b""")
def packed_codes(spark, sf_dir):
    """All folded samples of a block, of 17 bits each, packed in a row."""
    q = pcm_blocks(spark, sf_dir).withColumn("c", F.transform("samples", lambda x: pcm.fold_sign(pcm.quantise(x, 16))))
    bits = K.pack_codes(F.col("c"), F.array_repeat(F.lit(17), 64))
    return q.select("block", bits.alias("bits"), F.length(bits).cast("long").alias("bit_len"))
