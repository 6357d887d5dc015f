"""Signatures, checksums, containers and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksums
from ..sources import containers as C
from ..sources.adaptors import frame_facts, pcm_blocks, read
from ..sources.files import decode_files, encode_streams
from .registry import FRAMES, query

#: Heads that the texts of documents are given in turn, and what they are.
HEADS = (
    (b"RIFF\x24\0\0\0WAVE", "wav"), (b"fLaC", "flac"), (b"OggS\0\2OpusHead", "opus"), (b"OggS\0\2\1vorbis", "vorbis"),
    (b"\0\0\0\x14ftypM4A \0\0\0\0mp42", "aac"), (b"\xff\xf1", "aac"), (b"ID3", "mp3"), (b"\xff\xfb", "mp3"), (b"OggS", None), (b"", None),
)
_KINDS = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(HEADS) if kind) + " END"


@query(f"SELECT doc_id, {_KINDS} AS format FROM documents")
def sniff_format(spark, sf_dir):
    """Format of every text under a head that tells it."""
    head = F.get(F.array(*(F.lit(bytearray(h)) for h, _ in HEADS)), (F.col("doc_id") % len(HEADS)).cast("int"))
    data = F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))
    return read(spark, sf_dir, "documents").select("doc_id", C.sniff(data).alias("format"))


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents")
def payload_size(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.length(text).cast("long").alias("n_chars"))


#: 16-bit steps in closed form, by the parity of the byte; 32-bit ones by tables that repeated shifts make.
_STEP16 = "lambda c, b: xor(c * 256 % 65536, xor(bit_count(xor(c // 256, b)) % 2 * 32771, xor(xor(c // 256, b) * 2, xor(c // 256, b) * 4)))"


@query(f"""WITH RECURSIVE s AS (SELECT b, 0 AS k, b::BIGINT * 16777216 AS up, b::BIGINT AS down FROM range(256) t(b) UNION ALL
SELECT b, k + 1, xor(up * 2 % 4294967296, CASE WHEN up >= 2147483648 THEN 79764919 ELSE 0 END), xor(down // 2, CASE WHEN down % 2 = 1 THEN 3988292384 ELSE 0 END) FROM s WHERE k < 8),
tab AS (SELECT list(up ORDER BY b) AS ups, list(down ORDER BY b) AS downs FROM s WHERE k = 8),
o AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS o FROM documents)
SELECT doc_id, list_reduce(list_prepend(0::BIGINT, o), {_STEP16}) AS crc16_flac, list_reduce(list_prepend(65535::BIGINT, o), {_STEP16}) AS crc16_mpeg,
list_reduce(list_prepend(0::BIGINT, o), lambda c, b: xor(c * 256 % 4294967296, ups[xor(c // 16777216, b) + 1])) AS crc32_ogg,
xor(list_reduce(list_prepend(4294967295::BIGINT, o), lambda c, b: xor(c // 256, downs[xor(c % 256, b) + 1])), 4294967295) AS crc32_zlib FROM o CROSS JOIN tab""")
def checksum_table(spark, sf_dir):
    """CRC-16 of either start, unreflected CRC-32 and the zlib one of every text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", checksums.crc16_column(text).alias("crc16_flac"), checksums.crc16_column(text, 0xFFFF).alias("crc16_mpeg"), checksums.column(checksums.crc32_ogg, text).alias("crc32_ogg"), F.crc32(text).alias("crc32_zlib"))


@query("SELECT h.doc_id, h.b AS octet, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(upper(hex(encode(coalesce(text, '')))), '(..)', '\\1 ', 'g'), ' ')) AS b FROM documents) h WHERE h.b <> '' GROUP BY h.doc_id, h.b")
def byte_histogram(spark, sf_dir):
    """How often each byte occurs in each text, by its two hex digits."""
    digits = F.regexp_extract_all(F.hex(F.coalesce("text", F.lit("")).cast("binary")), F.lit("(..)"), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(digits).alias("octet")).groupBy("doc_id", "octet").agg(F.count("*").alias("n"))


_KBPS = "CASE (stream_id % 3) WHEN 0 THEN 128 WHEN 1 THEN 192 ELSE 96 END"


@query(f"""WITH {FRAMES}, f AS (SELECT stream_id, frame, {_KBPS} AS kbps, (frame % 2)::BIGINT AS padding FROM fr) SELECT stream_id, frame, kbps::BIGINT AS kbps, (144000 * kbps // 44100 + padding)::BIGINT AS length, coalesce(sum(144000 * kbps // 44100 + padding) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f""")
def mpeg_frame_walk(spark, sf_dir):
    """Headers and offsets of the frames of a Layer III stream, walked in its bytes."""
    import pandas as pd

    head = lambda kbps, pad: F.concat(F.lit(bytearray(b"\xff\xfb")), F.unhex(F.lpad(F.hex(F.shiftleft(kbps, 4) + pad * 2), 2, "0")), F.lit(bytearray(b"\x44")))
    index = F.when(F.col("stream_id") % 3 == 0, 9).when(F.col("stream_id") % 3 == 1, 11).otherwise(7)
    kbps = F.when(F.col("stream_id") % 3 == 0, 128).when(F.col("stream_id") % 3 == 1, 192).otherwise(96)
    pad = F.col("frame") % 2
    length = F.floor(F.lit(144000) * kbps / 44100) + pad
    frame = F.concat(head(index, pad), F.unhex(F.repeat(F.lit("00"), (length - 4).cast("int"))))
    bytes_of = frame_facts(spark, sf_dir).select("stream_id", "frame", frame.alias("bytes")).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "bytes"))), lambda s: F.hex(s["bytes"])).alias("parts"))
    streams = bytes_of.select("stream_id", F.unhex(F.array_join("parts", "")).alias("content"))

    def walk(batches):
        for batch in batches:
            rows = [(r.stream_id, k, h.kbps, h.length, at) for r in batch.itertuples() for k, (at, h) in enumerate(C.mpeg_frames(bytes(r.content)))]
            yield pd.DataFrame(rows, columns=["stream_id", "frame", "kbps", "length", "offset"])

    return streams.mapInPandas(walk, "stream_id long, frame long, kbps long, length long, offset long")


@query("SELECT conv_id, sum(greatest((strlen(coalesce(text, '')) + 8183) // 8184, 1))::BIGINT AS frames, max(7 + least(strlen(coalesce(text, '')), 8184))::BIGINT AS longest, sum(strlen(coalesce(text, '')))::BIGINT AS payload FROM conversations GROUP BY conv_id")
def adts_round_trip(spark, sf_dir):
    """Turns of a conversation as ADTS frames, through an .m4a file and back; sizes of what comes out."""
    import pandas as pd

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))

    def trip(key, rows: pd.DataFrame) -> pd.DataFrame:
        # A frame's length has 13 bits: longer turns take several frames.
        pieces = (raw[k : k + 8184] for raw in (t.encode() for t in rows.sort_values("turn")["text"]) for k in range(0, max(1, len(raw)), 8184))
        stream = b"".join(C.adts_frame(piece, 48000, 2) for piece in pieces)
        frames = C.adts_frames(C.demux_m4a(C.mux_m4a(stream)))
        return pd.DataFrame([(key[0], len(frames), max(f.length for f in frames), sum(len(f.payload) for f in frames))], columns=["conv_id", "frames", "longest", "payload"])

    return turns.groupBy("conv_id").applyInPandas(trip, "conv_id long, frames long, longest long, payload long")


@query("SELECT conv_id, count(*)::BIGINT AS packets, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, max(turn * 960 + 312)::BIGINT AS last_granule FROM conversations GROUP BY conv_id")
def ogg_round_trip(spark, sf_dir):
    """Turns of a conversation as packets of an Ogg stream, and back from its pages."""
    import pandas as pd

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))

    def trip(key, rows: pd.DataFrame) -> pd.DataFrame:
        packets = [(r.text.encode(), int(r.turn) * 960 + 312) for r in rows.sort_values("turn").itertuples()]
        back = C.ogg_packets(C.ogg_pages(C.mux_ogg(packets, int(key[0]) & 0xFFFFFFFF), check=True))
        return pd.DataFrame([(key[0], len(back), sum(len(p) for p, _ in back), max(g for _, g in back))], columns=["conv_id", "packets", "bytes", "last_granule"])

    return turns.groupBy("conv_id").applyInPandas(trip, "conv_id long, packets long, bytes long, last_granule long")


def _files(spark, sf_dir, kind: str, bits: int):
    streams = pcm_blocks(spark, sf_dir).select("block", F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"), F.col("samples").cast("array<float>").alias("samples"))
    coded = encode_streams(streams, kind, bits)
    return decode_files(coded.select("block", "samples", "content"))


def _round_trip_sql(bits: int) -> str:
    top = (1 << (bits - 1)) - 1
    return f"""WITH px AS (SELECT vec_id AS block, unnest(embedding) AS x FROM embeddings), q AS (SELECT block, CASE WHEN x <= -1 THEN -{top + 1} ELSE round(least(greatest(x, -1.0::FLOAT), 1.0::FLOAT) * {top}::FLOAT)::DOUBLE END AS q FROM px)
SELECT block, 44100::BIGINT AS sample_rate, 32::BIGINT AS frames, sum(q)::BIGINT AS total FROM q GROUP BY block"""


def _round_trip(spark, sf_dir, kind: str, bits: int):
    top = float((1 << (bits - 1)) - 1)
    back = F.aggregate("pcm.samples", F.lit(0).cast("long"), lambda s, x: s + F.when(x < 0, F.round(x.cast("double") * (top + 1))).otherwise(F.round(x.cast("double") * top)).cast("long"))
    files = _files(spark, sf_dir, kind, bits)
    return files.select("block", F.col("pcm.sample_rate").cast("long").alias("sample_rate"), (F.size("pcm.samples") / F.col("pcm.channels")).cast("long").alias("frames"), back.alias("total"))


@query(_round_trip_sql(16))
def wav_round_trip(spark, sf_dir):
    """Blocks as 16-bit WAV files, decoded: sums of the integers that come back."""
    return _round_trip(spark, sf_dir, "wav", 16)


@query(_round_trip_sql(16))
def flac_round_trip(spark, sf_dir):
    """The same through 16-bit FLAC files."""
    return _round_trip(spark, sf_dir, "flac", 16)


@query("SELECT vec_id AS block, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS value FROM embeddings")
def float_wav_round_trip(spark, sf_dir):
    """32-bit WAV files keep samples as they are: every one of them, read back."""
    long = _files(spark, sf_dir, "wav", 32).select("block", F.posexplode("pcm.samples").alias("i", "value"))
    return long.select("block", F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"))
