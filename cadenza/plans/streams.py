"""Incremental decoding over ordered chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adaptors import read
from ..sources.errors import AudioError
from ..streaming.decoder import decode_chunks
from .registry import query


def _sentence(raw: bytes) -> dict:
    """Stands in for a decoder: whole once 400 bytes are there."""
    if len(raw) < 400:
        raise AudioError("Incomplete")
    return {"format": "text", "sample_rate": 1, "channels": 1, "frames": len(raw)}


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT conv_id, turn, k, CASE WHEN n >= 400 THEN 0 ELSE n END AS buffered, CASE WHEN n = 0 THEN NULL WHEN n >= 400 THEN 'decoded' ELSE 'waiting' END AS status, CASE WHEN n >= 400 THEN n END AS frames FROM t WHERE k = 1
UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN s.buffered + n >= 400 THEN 0 ELSE s.buffered + n END, CASE WHEN s.buffered + n = 0 THEN NULL WHEN s.buffered + n >= 400 THEN 'decoded' ELSE 'waiting' END, CASE WHEN s.buffered + n >= 400 THEN s.buffered + n END FROM s JOIN t ON t.conv_id = s.conv_id AND t.k = s.k + 1)
SELECT conv_id::VARCHAR AS stream_id, turn::BIGINT AS seq, status, frames::BIGINT AS frames, buffered::BIGINT AS buffered FROM s WHERE status IS NOT NULL""")
def chunk_decoder(spark, sf_dir):
    """Turns of conversations as chunks of streams: what each gives, and what is left waiting."""
    chunks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("chunk"))
    return decode_chunks(chunks, decode=_sentence).select("stream_id", "seq", "status", "frames", "buffered")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS n, turn % 3 = 0 AS fresh, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT conv_id, turn, k, CASE WHEN n >= 400 THEN 0 ELSE n END AS buffered, CASE WHEN n = 0 THEN NULL WHEN n >= 400 THEN 'decoded' ELSE 'waiting' END AS status, CASE WHEN n >= 400 THEN n END AS frames FROM t WHERE k = 1
UNION ALL SELECT conv_id, turn, k, CASE WHEN n >= 400 THEN 0 ELSE n END, CASE WHEN n = 0 THEN NULL WHEN n >= 400 THEN 'decoded' ELSE 'waiting' END, CASE WHEN n >= 400 THEN n END FROM (SELECT t.conv_id, t.turn, t.k, n + CASE WHEN fresh THEN 0 ELSE s.buffered END AS n FROM s JOIN t ON t.conv_id = s.conv_id AND t.k = s.k + 1))
SELECT conv_id::VARCHAR AS stream_id, turn::BIGINT AS seq, status, frames::BIGINT AS frames, buffered::BIGINT AS buffered FROM s WHERE status IS NOT NULL""")
def chunk_resets(spark, sf_dir):
    """The same where every third turn begins anew."""
    chunks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("chunk"), (F.col("turn") % 3 == 0).alias("fresh"))
    return decode_chunks(chunks, decode=_sentence, reset="fresh").select("stream_id", "seq", "status", "frames", "buffered")
