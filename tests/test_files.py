"""Codecs and containers: goldens, round trips, malformed input."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import checksums as K
from cadenza.sources import containers as C
from cadenza.sources import flac, wav
from cadenza.sources.errors import AudioError
from cadenza.sources.files import decode_files, encode_streams, sniff_bytes
from cadenza.sources.pcm import Pcm


def tone(n=2048):
    return Pcm(44100, 1, np.sin(np.arange(n, dtype=np.float32) * np.float32(0.01)).astype(np.float32) * np.float32(0.25))


def test_golden_artifacts():
    w, f = wav.encode(tone(), 16), flac.encode(tone(), 16)
    assert (len(w), K.fnv1a64(w)) == (4140, 0xAE927D5DAF3773FA)
    assert (len(f), K.fnv1a64(f)) == (581, 0xC00BBB58509F22E9)
    assert len(flac.encode(tone(), 24)) == 980


def test_checksums():
    data = b"123456789"
    assert (K.crc8(data), K.crc16(data), K.crc32_ogg(data)) == (0xF4, 0xFEE8, 0x89A1897F)
    assert K.lockstep_crc16([data, b"", b"1"]).tolist() == [K.crc16(data), 0, K.crc16(b"1")]


def test_checksums_of_pieces():
    rnd = np.random.default_rng(4)
    rows = [rnd.bytes(n) for n in (0, 1, 255, 256, 257, 511, 512, 513, 5000, 0, 70000)]
    for start in (0, 0xFFFF):
        assert K.lockstep_crc16(rows, start).tolist() == [K.crc16(r, start) for r in rows]
    assert K.lockstep_crc16([]).tolist() == []


def test_checksum_columns_hold_a_slice(spark, monkeypatch):
    """A batch of any size is gone through by slices, in one pass with one worker: no other kind of Python stage."""
    rows = [(k, None if k == 7 else bytearray(b"a\xffz" * (k * 97 % 1000))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, raw binary").coalesce(1)
    most = []
    plain = K.sliced_crc16
    monkeypatch.setattr(K, "sliced_crc16", lambda data, offsets, start=0: most.append(int(offsets[-1] - offsets[0])) or plain(data, offsets, start))
    monkeypatch.setattr(K, "SLICE", 9000)
    arrow = pa.array([None if r is None else bytes(r) for _, r in rows], pa.binary())
    assert K.crc16_array(arrow[3:], 5).to_pylist() == [None if r is None else K.crc16(r, 5) for _, r in rows[3:]]
    assert len(most) > 10 and max(most) <= 9000
    found = df.select("k", K.crc16_column(F.col("raw"), 5).alias("a"), K.column(K.crc32_ogg, F.col("raw")).alias("b"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert {r["k"]: (r["a"], r["b"]) for r in found.collect()} == {k: (None, None) if r is None else (K.crc16(r, 5), K.crc32_ogg(bytes(r))) for k, r in rows}


def test_wav_golden():
    raw = bytes.fromhex("524946463400000057415645666d74201000000001000200 80bb000000ee020004001000 6461746110000000 00000000 004000c0 ff7f0080 002000e0".replace(" ", ""))
    assert wav.encode(Pcm(48000, 2, [0, 0, 0.5, -0.5, 1, -1, 0.25, -0.25]), 16) == raw
    assert wav.decode(raw).samples.tolist()[:6] == pytest.approx([0, 0, 16384 / 32767, -0.5, 1, -1])


def test_wav_eight_bits():
    form = b"\1\0\1\0" + (8000).to_bytes(4, "little") * 2 + b"\1\0\x08\0"
    raw = b"RIFF" + (4 + 24 + 8 + 4).to_bytes(4, "little") + b"WAVEfmt \x10\0\0\0" + form + b"data\3\0\0\0" + bytes([0, 128, 255]) + b"\0"
    assert wav.decode(raw).samples.tolist() == [-1, 0, 127 / 128]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1.5, 1.5, width=32), min_size=2, max_size=300), st.sampled_from([1, 2, 3]), st.sampled_from([16, 24]))
def test_lossless_round_trips(samples, channels, bits):
    samples = (samples * channels)[: len(samples) // channels * channels or channels]
    pcm = Pcm(48000, channels, (samples * channels)[: max(channels, len(samples) // channels * channels)])
    a, b = flac.decode(flac.encode(pcm, bits)), wav.decode(wav.encode(pcm, bits))
    assert np.array_equal(a.samples, b.samples) and a.channels == channels
    # Half a step of rounding, and up to one for negatives, which are coded by 2^(bits-1) - 1 and decoded by 2^(bits-1).
    assert np.abs(a.samples - np.clip(pcm.samples, -1, 1)).max() <= 1.6 / (1 << (bits - 1))


def test_flac_blocks_and_stereo():
    t = np.arange(9000)
    left = np.sin(t / 20)
    pcm = Pcm(48000, 2, np.stack([left, left * 0.9], 1).ravel())
    raw = flac.encode(pcm, 16)
    assert flac.decode(raw).frames == 9000
    info, _ = flac.stream_info(raw)
    assert (info.min_block, info.max_block, info.total) == (4096, 4096, 9000)


MALFORMED = [b"", b"RIFF", b"RIFF\x24\0\0\0WAVE", b"fLaC\0", b"ID3\4", b"OggS\0\2OpusHead", b"OggS", b"\0\0\0\x10ftypM4A \0\0\0\0", b"\xff\xf1\x50\x40", b"\xff" * 4096]


@pytest.mark.parametrize("raw", MALFORMED)
def test_malformed_raises_only_its_own_error(raw):
    for f in (wav.decode, flac.decode, C.mpeg_frames, C.adts_frames, C.demux_m4a, lambda r: C.ogg_packets(C.ogg_pages(r))):
        try:
            f(raw)
        except AudioError:
            pass


def test_corrupt_flac_is_noticed():
    raw = bytearray(flac.encode(tone(), 16))
    raw[300] ^= 0x10
    with pytest.raises(AudioError):
        flac.decode(bytes(raw))
    with pytest.raises(AudioError, match="Incomplete"):
        flac.decode(flac.encode(tone(), 16)[:400])


def test_sniff_agrees(spark):
    rows = [(bytearray(r),) for r in MALFORMED] + [(bytearray(wav.encode(tone(8))),), (bytearray(b"\0\0\0\x18ftypqt  M4A qt  M4A "),), (bytearray(b"\0\0\0\x10ftypqt  M4A "),), (None,)]
    found = [r["k"] for r in spark.createDataFrame(rows, "b binary").select(C.sniff(F.col("b")).alias("k")).collect()]
    assert found == [None if r[0] is None else sniff_bytes(bytes(r[0])) for r in rows]
    assert found[-3:] == ["aac", None, None]


def test_mpeg_header():
    head = C.mpeg_header(bytes.fromhex("fffb9064"))
    assert (head.version, head.layer, head.kbps, head.rate, head.mode, head.length, head.samples) == (3, 3, 128, 44100, 1, 417, 1152)
    assert head.to_bytes() == bytes.fromhex("fffb9064")


def test_adts_and_m4a():
    frame = C.adts_frames(bytes.fromhex("fff15040017ffc0000000e"))[0]
    assert (frame.rate, frame.channels, frame.length) == (44100, 1, 11)
    stream = b"".join(C.adts_frame(bytes([k]) * (k + 1), 44100, 2) for k in range(5))
    assert C.demux_m4a(C.mux_m4a(stream)) == stream
    assert {p for p, *_ in C.boxes(C.mux_m4a(stream))} >= {"/ftyp", "/moov/trak/mdia/minf/stbl/stsz", "/mdat"}


def test_ogg_long_packets():
    packets = [(b"", 0), (b"a" * 255, 1), (bytes(range(256)) * 700, 2), (b"end", 3)]
    pages = C.ogg_pages(C.mux_ogg(packets, 7), check=True)
    assert C.ogg_packets(pages) == packets
    assert pages[0].flags == 2 and pages[-1].flags == 4


def test_opus_heads():
    assert C.opus_toc(0xFC) == {"config": 31, "stereo": 1, "count_code": 0, "frame_samples": 960}
    packets = [(C.opus_head(2, 312, 48000), 0), (b"OpusTags", 0), (b"x", 960), (b"y", 1920)]
    assert C.opus_span(packets) == (312, 1608)


def test_bad_rows_don_t_fail_the_job(spark):
    rows = spark.createDataFrame([(1, 44100, 1, [0.0, 0.5]), (2, 0, 1, [0.0]), (3, 8000, 2, [0.1]), (4, None, None, None)], "id int, sample_rate int, channels int, samples array<float>")
    coded = {r["id"]: r for r in encode_streams(rows, "flac", 16).collect()}
    assert [coded[k]["error_code"] for k in (1, 2, 3, 4)] == [None, "InvalidPcm", "InvalidPcm", "InvalidPcm"]
    files = spark.createDataFrame([(1, coded[1]["content"]), (2, bytearray(b"RIFF")), (3, None), (4, bytearray(b"fLaC\0"))], "id int, content binary")
    found = {r["id"]: r["pcm"] for r in decode_files(files).collect()}
    assert found[1]["sample_rate"] == 44100 and found[1]["error_code"] is None
    assert [found[k]["error_code"] for k in (2, 3, 4)] == ["UnsupportedFormat", "UnsupportedFormat", "Incomplete"]


def test_audio_source(spark, tmp_path):
    from cadenza.sources.files import AudioSource

    (tmp_path / "a.wav").write_bytes(wav.encode(tone(10)))
    (tmp_path / "b.bin").write_bytes(b"junk")
    spark.dataSource.register(AudioSource)
    rows = {r["path"].rsplit("/")[-1]: r for r in spark.read.format("audio").load(str(tmp_path)).collect()}
    assert rows["a.wav"]["sample_rate"] == 44100 and len(rows["a.wav"]["samples"]) == 10
    assert rows["b.bin"]["error_code"] == "UnsupportedFormat"
    streams = spark.createDataFrame([("x", 8000, 2, [0.0, 0.5, -0.5, 1.0]), ("y", 8000, 1, [0.25])], "name string, sample_rate int, channels int, samples array<float>")
    streams.write.format("audio").option("kind", "wav").mode("append").save(str(tmp_path / "out"))
    back = {r["path"].rsplit("/")[-1]: r for r in spark.read.format("audio").load(str(tmp_path / "out")).collect()}
    assert back["x.wav"]["samples"] == [0.0, 0.5, -0.5, 1.0] and back["x.wav"]["channels"] == 2 and set(back) == {"x.wav", "y.wav"}


def test_silent_goldens():
    from cadenza.sources import lossy

    silence = Pcm(44100, 1, np.zeros(2048))
    mp3 = lossy.encode("MP3", silence)
    assert (len(mp3), K.fnv1a64(mp3)) == (834, 0x748FB13E884F2E07)
    assert lossy.decode_silent_mp3(mp3).frames == 2304
    aac = lossy.encode("aac", Pcm(44100, 1, np.zeros(1000)))
    assert (len(aac), K.fnv1a64(aac)) == (11, 0xC01800B6F2197B06)
    assert lossy.decode_silent_aac(aac).frames == lossy.decode_silent_aac(lossy.encode("m4a", silence)).frames // 2 == 1024
    assert sniff_bytes(lossy.encode("m4a", silence)) == "aac"
    for kind in ("mp3", "aac", "opus"):
        with pytest.raises(AudioError, match="UnsupportedFeature"):
            lossy.encode(kind, tone())
    with pytest.raises(AudioError, match="UnsupportedFormat"):
        lossy.encode("wma", tone())
    assert flac.stream_info(lossy.encode("flac", tone()))[0].depth == 24


@pytest.mark.parametrize("rate", [16000, 22050, 32000, 48000])
@pytest.mark.parametrize("channels", [1, 2])
def test_silent_mp3_of_all_rates(rate, channels):
    from cadenza.sources import lossy

    raw = lossy.encode("mp3", Pcm(rate, channels, np.zeros(3000 * channels)))
    assert {(h.rate, h.channels) for _, h in C.mpeg_frames(raw)} == {(rate, channels)}


def test_adts_frames_hold_whole_turns(spark, tmp_path):
    from cadenza import plans

    rows = [(1, 0, "é" * 1500), (1, 1, ""), (2, 0, "a" * 8184), (3, 0, "b" * 20000), (3, 1, None), (4, 0, "c" * 8185)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: (r["frames"], r["longest"], r["payload"]) for r in plans.QUERIES["adts_round_trip"](spark, str(tmp_path)).collect()}
    assert found == {1: (2, 3007, 3000), 2: (1, 8191, 8184), 3: (4, 8191, 20000), 4: (2, 8191, 8185)}
