"""Frames and blocks of signals, field widths, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import pcm
from ..operators import codebooks as K
from ..operators import layout as L
from ..sources.adaptors import event_signal, frame_facts, pcm_blocks, read, stereo_blocks
from .containers import _KINDS, HEADS
from .quality import _r
from .registry import EVENT_SIGNAL, FRAMES, PX, STEREO, query, rounded


@query(f"""WITH {EVENT_SIGNAL}, n AS (SELECT user_id, count(*) * 331 AS n FROM ev GROUP BY user_id) SELECT user_id, n::BIGINT AS samples, greatest(ceil(n / 1024.0), 1)::BIGINT AS long_frames, ceil(n / 1152.0)::BIGINT AS frames, ceil(n / 576.0)::BIGINT AS low_rate_frames, ceil(n / 4096.0)::BIGINT AS blocks, (n - 4096 * (ceil(n / 4096.0)::BIGINT - 1))::BIGINT AS last_block FROM n""")
def frame_layout(spark, sf_dir):
    """Frames and blocks of each user's signal, were each event 331 samples."""
    n = F.col("samples")
    sizes = event_signal(spark, sf_dir).groupBy("user_id").agg((F.count("*") * 331).alias("samples")).withColumn("sizes", L.block_sizes(n))
    return sizes.select("user_id", "samples", L.frame_count(n, 1024, 1).alias("long_frames"), L.frame_count(n, 1152).alias("frames"), L.frame_count(n, 576).alias("low_rate_frames"), F.size("sizes").cast("long").alias("blocks"), F.element_at("sizes", -1).alias("last_block"))


@query(f"WITH {PX} SELECT block, i, {rounded('coalesce(lag(x, 5) OVER w, 0) + coalesce(lead(x, 3) OVER w, 0)')} AS value FROM px WINDOW w AS (PARTITION BY block ORDER BY i)")
def signed_reads(spark, sf_dir):
    """Samples five before and three after each, zero outside the block, added."""
    value = pcm.let(F.col("samples"), lambda x: pcm.each(64, lambda i: pcm.signed_read(x, i - 5) + pcm.signed_read(x, i + 3)))
    long = pcm_blocks(spark, sf_dir).select("block", F.posexplode(value).alias("i", "v"))
    return long.select("block", F.col("i").cast("long").alias("i"), _r("v").alias("value"))


@query(f"WITH {STEREO} SELECT pair, {rounded('sum(l * (i + 1))')} AS \"left\", {rounded('sum(r * (i + 1))')} AS \"right\", count(*)::BIGINT AS n FROM st GROUP BY pair")
def stereo_split(spark, sf_dir):
    """Interleaved pairs split into channels again, as sums weighted by place."""
    mixed = stereo_blocks(spark, sf_dir).select("pair", L.interleaved(F.col("left"), F.col("right")).alias("s"))
    of = lambda k: pcm.total(F.transform(L.channel(F.col("s"), 2, k), lambda x, i: x * (i + 1)))
    return mixed.select("pair", _r(of(0)).alias("left"), _r(of(1)).alias("right"), F.size(L.channel(F.col("s"), 2, 0)).cast("long").alias("n"))


@query(f"WITH {STEREO}, s AS (SELECT st.*, p.stream_id FROM st JOIN (SELECT DISTINCT block, stream_id FROM px) p ON p.block = st.pair * 2) SELECT stream_id, {rounded('CASE WHEN sum(l * l + r * r) <= 0 THEN 0 ELSE sum((l - r) * (l - r)) / 2 / sum(l * l + r * r) END')} AS side_fraction, sum((l - r) * (l - r)) / 2 < 0.2 * sum(l * l + r * r) AS use_ms FROM s GROUP BY stream_id")
def stream_mid_side(spark, sf_dir):
    """Whether a whole stream is coded as mid and side: its side has less than 0.2 of the energy."""
    firsts = pcm_blocks(spark, sf_dir).where("block % 2 = 0").select(F.floor(F.col("block") / 2).alias("pair"), "stream_id")
    energy = lambda f: pcm.total(F.zip_with("left", "right", f))
    pairs = stereo_blocks(spark, sf_dir).select("pair", energy(lambda a, b: (a - b) * (a - b) / 2).alias("side"), energy(lambda a, b: a * a + b * b).alias("all"))
    sums = pairs.join(firsts, "pair").groupBy("stream_id").agg(F.sum("side").alias("side"), F.sum("all").alias("all"))
    return sums.select("stream_id", _r(F.when(F.col("all") <= 0, 0.0).otherwise(F.col("side") / F.col("all"))).alias("side_fraction"), (F.col("side") < 0.2 * F.col("all")).alias("use_ms"))


_FACTORS = f"{PX}, sc AS (SELECT block, i * 21 // 64 AS band, max(floor(abs(x) * CASE WHEN i < 34 THEN 24 ELSE 12 END))::BIGINT AS f FROM px GROUP BY block, band)"
_FACTOR_BANDS = [(next(i for i in range(65) if i * 21 // 64 >= b), next(i for i in range(66) if i * 21 // 64 >= b + 1 or i == 64)) for b in range(21)]
_WIDTHS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(L.WIDTHS))


def _factors(spark, sf_dir):
    loud = F.transform("samples", lambda x, i: F.floor(F.abs(x) * F.when(i < 34, 24).otherwise(12)))
    return pcm_blocks(spark, sf_dir).withColumn("loud", loud).select("block", F.array(*(F.array_max(F.slice("loud", a + 1, b - a)) for a, b in _FACTOR_BANDS)).alias("factors"))


@query(f"WITH {_FACTORS}, w(code, a, b) AS (VALUES {_WIDTHS}), m AS (SELECT block, max(CASE WHEN band < 11 THEN f END) AS low, max(CASE WHEN band >= 11 THEN f END) AS high FROM sc GROUP BY block) SELECT block, (SELECT min(code) FROM w WHERE low < (1 << a) AND high < (1 << b))::BIGINT AS code FROM m")
def scale_factor_widths(spark, sf_dir):
    """Code of the first field widths that hold the 21 scale factors of each block."""
    return _factors(spark, sf_dir).select("block", L.width_code(F.col("factors"), 11).alias("code"))


_W = "(CASE WHEN {0} = 0 THEN 0 ELSE strlen(bin({0})) END)"


@query(f"""WITH {_FACTORS}, g AS (SELECT block, max(CASE WHEN band < 6 THEN f END) AS a, max(CASE WHEN band BETWEEN 6 AND 10 THEN f END) AS b, max(CASE WHEN band BETWEEN 11 AND 15 THEN f END) AS c, max(CASE WHEN band >= 16 THEN f END) AS d, max(CASE WHEN band BETWEEN 11 AND 17 THEN f END) AS c2, max(CASE WHEN band >= 18 THEN f END) AS d2 FROM sc GROUP BY block),
w AS (SELECT block, {_W.format('a')} AS a, {_W.format('b')} AS b, {_W.format('c')} AS c, {_W.format('d')} AS d, {_W.format('c2')} AS c2, {_W.format('d2')} AS d2 FROM g),
o AS (SELECT block, 6 * a + 5 * b + 5 * c + 5 * d AS bits, 0 AS branch, (a * 5 + b) * 16 + c * 4 + d AS code FROM w WHERE a <= 4 AND b <= 4 AND c <= 3 AND d <= 3 UNION ALL SELECT block, 6 * a + 5 * b + 7 * c2, 1, 400 + (a * 5 + b) * 4 + c2 FROM w WHERE a <= 4 AND b <= 4 AND c2 <= 3 AND d2 = 0)
SELECT w.block, min(bits)::BIGINT AS bits, arg_min(branch, (bits, branch))::BIGINT AS branch, arg_min(code, (bits, branch))::BIGINT AS code FROM w LEFT JOIN o USING (block) GROUP BY w.block""")
def low_rate_partitions(spark, sf_dir):
    """The cheaper partition of the 21 scale factors at low rates; null where none holds them."""
    found = _factors(spark, sf_dir).select("block", L.partition_code(F.col("factors")).alias("p"))
    return found.select("block", F.col("p.bits").cast("long").alias("bits"), F.col("p.branch").cast("long").alias("branch"), F.col("p.code").cast("long").alias("code"))


@query(f"""WITH {PX}, s(step) AS (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)), q AS (SELECT block, step, (sign(x) * round(pow(abs(x), 0.75) / step))::BIGINT AS q FROM px CROSS JOIN s) SELECT block, step, CASE WHEN max(abs(q)) <= 15 THEN sum(q)::BIGINT END AS total, max(abs(q)) <= 15 AS fits FROM q GROUP BY block, step""")
def bounded_quantise(spark, sf_dir):
    """Steps whose values stay within 15; a step with a larger one is ruled out."""
    steps = pcm_blocks(spark, sf_dir).withColumn("step", F.explode(F.lit([0.01, 0.02, 0.05])))
    q = steps.select("block", "step", L.bounded(F.transform("samples", lambda x: C.power_quantise(x, F.col("step"))), 15).alias("q"))
    return q.select("block", "step", F.aggregate("q", F.lit(0).cast("long"), lambda t, v: t + v).alias("total"), F.col("q").isNotNull().alias("fits"))


#: Pulses that the table of counts goes up to: more than eight samples in -1 to 1 give here.
_PULSES = 64


@query(f"""WITH RECURSIVE {PX}, p AS (SELECT block, i // 8 AS part, sum(round(abs(x) * 6))::BIGINT AS pulses FROM px GROUP BY block, part), ch(n, k, c) AS (SELECT n, 0, 1::DOUBLE FROM (SELECT unnest(range({_PULSES})) AS n) UNION ALL SELECT n, k + 1, c * (n - k) / (k + 1) FROM ch WHERE k < n),
v AS (SELECT k.k AS pulses, CASE WHEN k.k = 0 THEN 1 ELSE sum(pow(2, a.k) * a.c * b.c) END AS words FROM (SELECT unnest(range({_PULSES + 1})) AS k) k LEFT JOIN ch a ON a.n = 8 AND a.k BETWEEN 1 AND k.k LEFT JOIN ch b ON b.n = k.k - 1 AND b.k = a.k - 1 WHERE k.k = 0 OR b.c IS NOT NULL GROUP BY k.k)
SELECT block, part::BIGINT AS part, pulses, words::BIGINT AS words, {rounded('log2(words)', 3)} AS bits FROM p LEFT JOIN v USING (pulses)""")
def pulse_codewords(spark, sf_dir):
    """How many vectors of eight values hold a part's pulses, and the bits to tell one."""
    pulses = pcm.each(8, lambda k: pcm.total(F.slice("samples", k * 8 + 1, 8), lambda x: F.round(F.abs(x) * 6)).cast("long"))
    words = F.get(F.lit([K.pulse_codewords(8, k) for k in range(_PULSES + 1)]), F.col("pulses").cast("int")).cast("long")
    long = pcm_blocks(spark, sf_dir).select("block", F.posexplode(pulses).alias("part", "pulses"))
    return long.select("block", F.col("part").cast("long").alias("part"), "pulses", words.alias("words"), _r(F.log2(words), 3).alias("bits"))


@query(f"""WITH {FRAMES}, b AS (SELECT stream_id, count(*) AS frames, max(payload) AS longest, min(400 - payload) AS slack, sum(payload * 8) AS total, sum(CASE WHEN payload > 300 THEN payload * 8 ELSE 0 END) AS escape FROM fr GROUP BY stream_id),
s AS (SELECT stream_id, count(*) AS bands, count(CASE WHEN d > 0 THEN 1 END) AS raised, max(d) AS top, avg(d) AS mean FROM (SELECT stream_id, (tax * 100)::BIGINT AS d FROM fr) GROUP BY stream_id)
SELECT stream_id, frames, longest::BIGINT AS longest, slack::BIGINT AS least_slack, total::BIGINT AS total_bits, escape::BIGINT AS escape_bits, bands, raised, top::BIGINT AS max_delta, {rounded('mean')} AS mean_delta FROM b JOIN s USING (stream_id)""")
def control_profile(spark, sf_dir):
    """Payload and scale-factor profiles of each stream side by side, with the least slack of its budget."""
    frames = frame_facts(spark, sf_dir)
    delta = F.round(F.col("tax") * 100).cast("long")
    bits = F.col("payload") * 8
    return frames.groupBy("stream_id").agg(
        F.count("*").alias("frames"), F.max("payload").alias("longest"), F.min(400 - F.col("payload")).alias("least_slack"), F.sum(bits).alias("total_bits"), F.sum(F.when(F.col("payload") > 300, bits).otherwise(0)).alias("escape_bits"),
        F.count(delta).alias("bands"), F.count(F.when(delta > 0, 1)).alias("raised"), F.max(delta).alias("max_delta"), _r(F.avg(delta)).alias("mean_delta"),
    )


@query(f"SELECT doc_id, '{{\"name\":\"' || doc_id || '.bin\",\"format\":\"' || coalesce({_KINDS}, 'unknown') || '\",\"bytes\":' || (strlen(coalesce(text, '')) + CASE doc_id % 10 {' '.join(f'WHEN {k} THEN {len(h)}' for k, (h, _) in enumerate(HEADS))} END) || '}}' AS entry FROM documents")
def artifact_manifest(spark, sf_dir):
    """An entry of the manifest, as JSON, for each text under its head: name, format and size."""
    from ..sources import containers as S

    head = F.get(F.array(*(F.lit(bytearray(h)) for h, _ in HEADS)), (F.col("doc_id") % len(HEADS)).cast("int"))
    data = F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))
    entry = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".bin")).alias("name"), F.coalesce(S.sniff(data), F.lit("unknown")).alias("format"), F.octet_length(data).alias("bytes"))
    return read(spark, sf_dir, "documents").select("doc_id", F.to_json(entry).alias("entry"))
