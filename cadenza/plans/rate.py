"""Rate control: padding, budgets, reservoir, allocation, step selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import rate as R
from ..operators import scan
from ..sources.adaptors import frame_facts, pcm_blocks, read
from .quality import _r
from .registry import FRAMES, PX, query, rounded

#: Bit rates of a Layer III stream in kbit/s; fixed values of the format.
BITRATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_BITRATES = ", ".join(f"({b})" for b in BITRATES)


@query(f"WITH {FRAMES} SELECT stream_id, frame, ((frame + 1) * 42300 // 44100 - frame * 42300 // 44100)::BIGINT AS padding, (417 + (frame + 1) * 42300 // 44100 - frame * 42300 // 44100)::BIGINT AS frame_bytes FROM fr")
def padding_schedule(spark, sf_dir):
    """Padding of the frames of a 128 kbit/s stream at 44.1 kHz."""
    pad = R.padded(F.col("frame"), 128 * 144000 % 44100, 44100).cast("long")
    return frame_facts(spark, sf_dir).select("stream_id", "frame", pad.alias("padding"), R.frame_bytes(128, 44100, pad).alias("frame_bytes"))


@query("""WITH r(rate) AS (VALUES (8000), (16000), (22050), (32000), (44100), (48000), (96000)), c AS (SELECT c_nationkey, c_custkey, (8000 + c_custkey * 37 % 300000)::BIGINT AS bps FROM customer)
SELECT c_custkey AS id, rate::BIGINT AS rate, greatest(ceil(bps * 1024.0::DOUBLE / (rate * 8)), 7)::BIGINT AS bytes FROM c CROSS JOIN r""")
def frame_budget(spark, sf_dir):
    """Bytes of a 1024-sample frame at bit rates and sampling rates."""
    rates = F.explode(F.array(*(F.lit(r) for r in (8000, 16000, 22050, 32000, 44100, 48000, 96000))))
    bps = (8000 + F.col("c_custkey") * 37 % 300000).cast("long")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), bps.alias("bps"), rates.alias("rate")).withColumn("rate", F.col("rate").cast("long")).select("id", "rate", R.frame_budget(F.col("bps"), F.col("rate")).alias("bytes"))


@query(f"""WITH {FRAMES}, b(kbps) AS (VALUES {_BITRATES}) SELECT stream_id, frame, payload, min(kbps)::BIGINT AS kbps FROM fr LEFT JOIN b ON kbps * 144000 // 44100 - 4 - 32 >= payload GROUP BY stream_id, frame, payload""")
def smallest_bitrate(spark, sf_dir):
    """The smallest bit rate whose stereo frame holds the payload; null where none does."""
    capacity = lambda b: b * 144000 // 44100 - 4 - 32
    fit = F.coalesce(*(F.when(F.col("payload") <= capacity(b), b) for b in BITRATES))
    return frame_facts(spark, sf_dir).select("stream_id", "frame", "payload", fit.cast("long").alias("kbps"))


@query(f"""WITH RECURSIVE {FRAMES}, st AS (SELECT stream_id, frame, least(payload, 200) AS used, 0::BIGINT AS main_data_begin, 200::BIGINT AS budget, 200 - least(payload, 200) AS reservoir_after, payload > 200 AS over FROM fr WHERE frame = 0
UNION ALL SELECT fr.stream_id, fr.frame, least(fr.payload, 200 + least(st.reservoir_after, 511)), least(st.reservoir_after, 511), 200 + least(st.reservoir_after, 511), 200 + least(st.reservoir_after, 511) - least(fr.payload, 200 + least(st.reservoir_after, 511)), fr.payload > 200 + least(st.reservoir_after, 511) FROM st JOIN fr ON fr.stream_id = st.stream_id AND fr.frame = st.frame + 1)
SELECT stream_id, frame, main_data_begin::BIGINT AS main_data_begin, budget::BIGINT AS budget, used::BIGINT AS used, reservoir_after::BIGINT AS reservoir_after, over FROM st""")
def bit_reservoir(spark, sf_dir):
    """Frames of 200 bytes that lend what they don't use."""
    return R.reservoir(frame_facts(spark, sf_dir).select("stream_id", "frame", "payload"), "stream_id", "frame", "payload", 200).drop("targeted")


@query(f"""WITH RECURSIVE {FRAMES}, st AS (SELECT stream_id, frame, 0::BIGINT AS begin, least(payload, 200) AS used, 200 - least(payload, 200) AS rest FROM fr WHERE frame = 0
UNION ALL SELECT fr.stream_id, fr.frame, least(rest, 511), least(fr.payload, 200 + least(rest, 511)), 200 + least(rest, 511) - least(fr.payload, 200 + least(rest, 511)) FROM st JOIN fr ON fr.stream_id = st.stream_id AND fr.frame = st.frame + 1),
iv AS (SELECT stream_id, frame, 200 * frame - begin AS a, 200 * frame - begin + used AS b FROM st)
SELECT iv.stream_id, iv.frame, s.frame AS slot, (greatest(a, 200 * s.frame) - a)::BIGINT AS payload_offset, (greatest(a, 200 * s.frame) - 200 * s.frame)::BIGINT AS slot_offset, (least(b, 200 * s.frame + 200) - greatest(a, 200 * s.frame))::BIGINT AS length
FROM iv JOIN st s ON s.stream_id = iv.stream_id AND a < 200 * s.frame + 200 AND b > 200 * s.frame""")
def reservoir_layout(spark, sf_dir):
    """Which bytes of each frame's payload lie where in which frame's slot."""
    facts = frame_facts(spark, sf_dir).select("stream_id", "frame", "payload")
    frames = R.reservoir(facts, "stream_id", "frame", "payload", 200).withColumn("slot", F.lit(200))
    return L.reservoir_pieces(frames, "stream_id", "frame", "slot", "main_data_begin", "used", scan.parts_for(facts))


_AIM = "greatest(least(((fr.tax * 20000)::BIGINT + 7) // 8, 200 + least({0}, 511)), 1)"
_WHOLE = "(200 + least({0}, 511))"


def _targeted(left: str) -> str:
    aim, whole = _AIM.format(left), _WHOLE.format(left)
    return f"least({left}, 511)::BIGINT AS main_data_begin, CASE WHEN fr.payload <= {aim} THEN {aim} ELSE {whole} END AS budget, least(fr.payload, {whole}) AS used, {whole} - least(fr.payload, {whole}) AS reservoir_after, fr.payload <= {aim} AS targeted"


@query(f"""WITH RECURSIVE {FRAMES}, st AS (SELECT stream_id, frame, {_targeted('0')} FROM fr WHERE frame = 0
UNION ALL SELECT fr.stream_id, fr.frame, {_targeted('st.reservoir_after')} FROM st JOIN fr ON fr.stream_id = st.stream_id AND fr.frame = st.frame + 1)
SELECT stream_id, frame, main_data_begin, budget::BIGINT AS budget, used::BIGINT AS used, reservoir_after::BIGINT AS reservoir_after, targeted FROM st""")
def targeted_reservoir(spark, sf_dir):
    """The same with a target of bits for each frame, from its weight."""
    frames = frame_facts(spark, sf_dir).select("stream_id", "frame", "payload", F.round(F.col("tax") * 20000).cast("long").alias("target"))
    return R.reservoir(frames, "stream_id", "frame", "payload", 200, target_bits="target").drop("over")


@query(f"WITH {FRAMES} SELECT stream_id, max(quantity::BIGINT) AS active, arg_max(discount, (quantity::BIGINT, -discount)) AS step FROM fr GROUP BY stream_id")
def most_active_step(spark, sf_dir):
    """The candidate of most active scale factors (the quantity here), and the finest step of equal ones."""
    c = frame_facts(spark, sf_dir).select("stream_id", F.col("quantity").cast("long").alias("active"), F.col("discount").alias("step"))
    return R.most_active(c, ["stream_id"], "active", "step")


@query(f"WITH {FRAMES}, m AS (SELECT *, min(discount) OVER (PARTITION BY stream_id) AS low FROM fr) SELECT stream_id, arg_min(frame, (payload, frame))::BIGINT AS frame, min(payload)::BIGINT AS payload FROM m WHERE discount <= low + 1e-9 GROUP BY stream_id")
def quality_guard(spark, sf_dir):
    """The least distorted candidate (by discount), the simplest (by payload) of equal ones."""
    c = frame_facts(spark, sf_dir).select("stream_id", "frame", "payload", "discount")
    return R.least_distorted(c, ["stream_id"], "discount", "payload", "frame")


@query(f"""WITH {FRAMES}, a AS (SELECT *, count(*) OVER g AS n, sum(tax) OVER g AS mass FROM fr WINDOW g AS (PARTITION BY stream_id)),
b AS (SELECT *, (mass <= 0 OR 4000 - n * 100 < 0) AS even FROM a), c AS (SELECT *, CASE WHEN even THEN 4000 ELSE 4000 - n * 100 END AS spare, CASE WHEN even THEN 1.0::DOUBLE / n ELSE tax / mass END AS share FROM b),
d AS (SELECT *, round(spare * share, 9) AS exact FROM c), e AS (SELECT *, floor(exact) AS down, round(exact - floor(exact), 6) AS part FROM d),
f AS (SELECT *, spare - sum(down) OVER (PARTITION BY stream_id) AS rest, row_number() OVER (PARTITION BY stream_id ORDER BY part DESC, frame) AS place FROM e)
SELECT stream_id, frame, ((CASE WHEN even THEN 0 ELSE 100 END) + down + (CASE WHEN place <= rest THEN 1 ELSE 0 END))::BIGINT AS bits FROM f""")
def bit_allocation(spark, sf_dir):
    """4000 bits of a stream in proportion to its frames' weights, 100 each at least."""
    return R.allocate(frame_facts(spark, sf_dir).select("stream_id", "frame", "tax"), ["stream_id"], "frame", "tax", 4000, 100).select("stream_id", "frame", "bits")


@query(f"WITH {FRAMES} SELECT stream_id, min(discount) AS step, arg_min(payload, (discount, -payload))::BIGINT AS payload FROM fr GROUP BY stream_id")
def finest_step(spark, sf_dir):
    """Of each stream's candidates the finest step, and the longest frame of equal steps."""
    c = frame_facts(spark, sf_dir).select("stream_id", F.col("discount").alias("step"), "payload")
    return R.finest_step(c, ["stream_id"], "step", "payload")


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY (payload > 120), CASE WHEN payload <= 120 THEN discount ELSE payload END, CASE WHEN payload <= 120 THEN -payload ELSE 0 END, discount, payload) AS place FROM fr)
SELECT stream_id, discount AS step, payload, payload <= 120 AS fits FROM r WHERE place = 1""")
def step_within_budget(spark, sf_dir):
    """The finest step within 120 bytes; where none fits, the shortest frame."""
    c = frame_facts(spark, sf_dir).select("stream_id", F.col("discount").alias("step"), "payload")
    return R.within_budget(c, ["stream_id"], "step", "payload", F.lit(120))


_CAND = ", ".join(f"({s}::DOUBLE)" for s in (0.02, 0.03, 0.045, 0.07, 0.1, 0.15))


@query(f"""WITH {PX}, s(step) AS (VALUES {_CAND}), q AS (SELECT block, step, abs(round(pow(abs(x), 0.75) / step)) AS m FROM px CROSS JOIN s), c AS (SELECT block, step, sum(1 + 2 * CASE WHEN m <= 0 THEN 0 ELSE length(bin(m::BIGINT)) END)::BIGINT AS bits FROM q GROUP BY block, step),
r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY (bits > 260), CASE WHEN bits <= 260 THEN step ELSE bits END) AS place FROM c)
SELECT block, step, bits, bits <= 260 AS fits FROM r WHERE place = 1""")
def step_search(spark, sf_dir):
    """The finest of six quantiser steps whose codes fit 260 bits, block by block."""
    from ..functions import pcm

    blocks = pcm_blocks(spark, sf_dir)
    bits = lambda s: F.aggregate("samples", F.lit(0).cast("long"), lambda t, x: t + 1 + 2 * pcm.bit_length(F.round(F.pow(F.abs(x), F.lit(0.75)) / s).cast("long")))
    options = F.array(*(F.struct(F.lit(s).alias("step"), bits(s).alias("bits")) for s in (0.02, 0.03, 0.045, 0.07, 0.1, 0.15)))
    rank = F.transform(options, lambda o: F.struct((o["bits"] > 260).alias("over"), F.when(o["bits"] <= 260, o["step"]).otherwise(o["bits"].cast("double")).alias("by"), o["step"].alias("step"), o["bits"].alias("bits")))
    best = blocks.select("block", F.array_min(rank).alias("m"))
    return best.select("block", "m.step", "m.bits", (~F.col("m.over")).alias("fits"))


@query(f"""WITH {FRAMES}, r AS (SELECT stream_id, frame, CASE WHEN frame % 2 = 0 THEN 1 ELSE 2 END AS lm, payload FROM fr)
SELECT stream_id, frame, least(greatest((payload * 8 + 100 + 32) >> 6, ((100 + 24 + 63) >> 6) + 2), 1275 >> (3 - lm))::BIGINT AS bytes FROM r""")
def variable_frame_bytes(spark, sf_dir):
    """Bytes of a variable-rate frame from its target in eighths of a bit, with what has been written and a boost."""
    lm = F.when(F.col("frame") % 2 == 0, 1).otherwise(2)
    most = F.when(lm == 1, 1275 >> 2).otherwise(1275 >> 1)
    want = F.greatest(F.shiftright(F.col("payload") * 8 + 132, 6), F.lit(((100 + 24 + 63) >> 6) + 2))
    return frame_facts(spark, sf_dir).select("stream_id", "frame", F.least(want, most).cast("long").alias("bytes"))


_SIZE = "least(greatest((fr.payload * 64 + 132) >> 6, ((100 + 24 + 63) >> 6) + 2), 637)"


def _drift(reservoir: str, drift: str, count: str) -> str:
    left = f"{reservoir} + {_SIZE} * 64 - 12800"
    gain = f"(CASE WHEN {count} < 970 THEN 1.0::DOUBLE / ({count} + 21) ELSE 0.001::DOUBLE END)"
    return f"least(637, {_SIZE} + CASE WHEN {left} < 0 THEN -({left}) // 64 ELSE 0 END) AS bytes, greatest({left}, 0) AS reservoir, {drift} + trunc({gain} * (fr.payload * 64 + 100 - 12800 + {drift} - {drift}))::BIGINT AS drift, {count} + 1 AS n"


@query(f"""WITH RECURSIVE {FRAMES}, st AS (SELECT stream_id, frame, {_drift('0', '0', '0')} FROM fr WHERE frame = 0
UNION ALL SELECT fr.stream_id, fr.frame, {_drift('st.reservoir', 'st.drift', 'st.n')} FROM st JOIN fr ON fr.stream_id = st.stream_id AND fr.frame = st.frame + 1)
SELECT stream_id, frame, bytes::BIGINT AS bytes, reservoir::BIGINT AS reservoir, drift::BIGINT AS drift FROM st""")
def rate_drift(spark, sf_dir):
    """Bytes, reservoir and drift of constrained variable-rate streams against 200 bytes a frame."""
    frames = frame_facts(spark, sf_dir).select("stream_id", "frame", (F.col("payload") * 64).alias("target"), F.lit(100).alias("spent"), F.lit(24).alias("boost"))
    return R.variable_rate_drift(frames, "stream_id", "frame", "target", "spent", "boost", nominal=200 * 64, ceiling=1275, lm=2)


#: First lines of the 21 bands at 48 kHz; fixed values of the format.
CELT_BANDS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100)
_LM, _INTENSITY = 3, 12
_BINS = (CELT_BANDS[21] << _LM) + (CELT_BANDS[_INTENSITY] << _LM)
_FREE = (CELT_BANDS[_INTENSITY] << _LM) - _INTENSITY


@query(f"""WITH {FRAMES}, a AS (SELECT stream_id, frame, payload * 64 AS base, tax * 10 AS saving, (quantity * 8)::BIGINT AS boost, discount * 2 AS tf, 5 + price / 5000 AS depth FROM fr),
b AS (SELECT *, base - trunc(least({0.8 * _FREE / _BINS!r}::DOUBLE * base, (least(saving, 1.0::DOUBLE) - 0.1) * {_FREE << 3}))::BIGINT AS t FROM a), c AS (SELECT *, t + boost - {19 << _LM} AS t2 FROM b), d AS (SELECT *, t2 + trunc((tf - 0.044) * t2)::BIGINT AS t3 FROM c),
e AS (SELECT *, least(t3, greatest(trunc({2 * (CELT_BANDS[19] << _LM) << 3} * depth)::BIGINT, t3 >> 2)) AS t4 FROM d), f AS (SELECT *, CASE WHEN frame % 2 = 0 THEN base + trunc(0.67::DOUBLE * (t4 - base))::BIGINT ELSE t4 END AS t5 FROM e),
g AS (SELECT *, CASE WHEN tf < 0.2 THEN t5 + trunc((1 - tf) * {0.0000031 * 32000!r}::DOUBLE * t5)::BIGINT ELSE t5 END AS t6 FROM f) SELECT stream_id, frame, least(t6, 2 * base)::BIGINT AS target FROM g""")
def variable_rate_target(spark, sf_dir):
    """The target of a stereo frame, in eighths of a bit, shaped by what its analysis found."""
    frames = frame_facts(spark, sf_dir).select("stream_id", "frame", (F.col("payload") * 64).alias("base"), (F.col("tax") * 10).alias("saving"), (F.col("quantity") * 8).cast("long").alias("boost"), (F.col("discount") * 2).alias("tf"), (5 + F.col("price") / 5000).alias("depth"))
    target = R.shaped_target(frames, constrained=F.col("frame") % 2 == 0, bins=_BINS, free=_FREE, floor_bins=2 * (CELT_BANDS[19] << _LM), average_boost=19 << _LM, temporal=1 - F.col("tf"), spare=32000)
    return target.select("stream_id", "frame", "target")


@query(f"""WITH {FRAMES} SELECT stream_id, max(payload * 10)::BIGINT AS longest, bool_or(payload * 10 > 4095) AS overflows FROM fr GROUP BY stream_id""")
def side_info_overflow(spark, sf_dir):
    """Whether any granule of a stream is longer than the twelve bits of its length field."""
    bits = F.col("payload") * 10
    return frame_facts(spark, sf_dir).groupBy("stream_id").agg(F.max(bits).alias("longest"), F.bool_or(R.overflows(bits)).alias("overflows"))


_KBPS = ", ".join(f"({b})" for b in BITRATES)


@query(f"""WITH {FRAMES}, k(kbps) AS (VALUES {_KBPS}), s AS (SELECT DISTINCT stream_id % 2 = 0 AS stereo, stream_id % 3 = 0 AS crc FROM fr) SELECT kbps::BIGINT AS kbps, stereo, crc, (kbps * 144000 // 44100 - 4 - (CASE WHEN stereo THEN 32 ELSE 17 END) - (CASE WHEN crc THEN 2 ELSE 0 END))::BIGINT AS bytes FROM k CROSS JOIN s""")
def payload_capacity(spark, sf_dir):
    """Main data that a frame of each bitrate holds, for the channel and checksum modes of the streams."""
    modes = frame_facts(spark, sf_dir).select((F.col("stream_id") % 2 == 0).alias("stereo"), (F.col("stream_id") % 3 == 0).alias("crc")).distinct()
    rates = modes.withColumn("kbps", F.explode(F.lit(list(BITRATES)))).withColumn("kbps", F.col("kbps").cast("long"))
    return rates.select("kbps", "stereo", "crc", R.payload_capacity(R.frame_bytes(F.col("kbps"), 44100), F.col("stereo"), F.col("crc")).cast("long").alias("bytes"))
