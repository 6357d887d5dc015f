"""The incremental decoder, on tables and streams."""

import numpy as np

from cadenza.sources import wav
from cadenza.sources.pcm import Pcm
from cadenza.streaming.decoder import decode_chunks, push


def chunks():
    raw = wav.encode(Pcm(8000, 1, np.linspace(-1, 1, 50)))
    rows = [("a", i, bytearray(raw[k : k + 30])) for i, k in enumerate(range(0, len(raw), 30))]
    return [*rows, ("b", 0, bytearray(b"")), ("b", 1, bytearray(b"nonsense, not audio")), ("c", 0, bytearray(raw)), ("c", 1, bytearray(raw[:20]))]


EXPECTED = {("a", "decoded"), ("a", "waiting"), ("b", "UnsupportedFormat"), ("c", "decoded"), ("c", "waiting")}


def test_table(spark):
    rows = decode_chunks(spark.createDataFrame(chunks(), "stream_id string, seq int, chunk binary")).collect()
    assert {(r["stream_id"], r["status"]) for r in rows} == EXPECTED
    done = [r for r in rows if r["stream_id"] == "a" and r["status"] == "decoded"]
    assert len(done) == 1 and done[0]["frames"] == 50 and done[0]["buffered"] == 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, row in enumerate(chunks()):
        spark.createDataFrame([row], "stream_id string, seq int, chunk binary").coalesce(1).write.mode("append").parquet(f"{source}/{i:03d}")
    stream = spark.readStream.schema("stream_id string, seq int, chunk binary").option("maxFilesPerTrigger", 6).option("recursiveFileLookup", "true").parquet(source)
    query = decode_chunks(stream).writeStream.format("memory").queryName("decoded").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.sql("select * from decoded").collect()
    assert any(r["stream_id"] == "a" and r["status"] == "decoded" and r["frames"] == 50 for r in rows)
    assert ("b", "UnsupportedFormat") in {(r["stream_id"], r["status"]) for r in rows}


def test_cap_and_errors():
    assert push(b"", b"", lambda raw: {}) == (b"", None, {})
    assert push(b"x" * 10, b"y", lambda raw: {}, cap=10) == (b"", "InvalidInput", {})
    assert push(b"ab", b"c", lambda raw: {"n": len(raw)}) == (b"", "decoded", {"n": 3})
