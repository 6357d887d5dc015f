"""Audio files as tables: decoding and encoding of columns, and a batch data source.

A bad file gives a row with its error instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import flac, wav
from .containers import demux_m4a, sniff
from .errors import AudioError
from .pcm import Pcm

PCM_SCHEMA = "format string, sample_rate int, channels int, samples array<float>, error_code string, error_detail string"
_PCM = pa.struct([("format", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32())), ("error_code", pa.string()), ("error_detail", pa.string())])


def _decoder(kind: str):
    from . import lossy

    known = {"wav": wav.decode, "flac": flac.decode, "mp3": lossy.decode_silent_mp3, "aac": lossy.decode_silent_aac}
    if kind not in known:
        raise AudioError("UnsupportedFeature", f"decoding of {kind}")
    return known[kind]


def decode_bytes(raw: bytes | None, kind: str | None) -> dict:
    """A row of PCM_SCHEMA.  Of the lossy formats only silent streams decode; others say so."""
    row = dict.fromkeys((f.name for f in _PCM), None) | {"format": kind}
    try:
        if raw is None or kind is None:
            raise AudioError("UnsupportedFormat")
        pcm = _decoder(kind)(raw)
        return row | {"sample_rate": pcm.sample_rate, "channels": pcm.channels, "samples": pcm.samples}
    except AudioError as e:
        return row | {"error_code": e.code, "error_detail": e.detail}


def decode_files(df: DataFrame, content: str = "content", out: str = "pcm") -> DataFrame:
    """Adds the struct ``out`` of PCM_SCHEMA."""
    df = df.withColumn("_kind", sniff(F.col(content)))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode_bytes(raw, kind) for raw, kind in zip(batch.column(names.index(content)).to_pylist(), batch.column(names.index("_kind")).to_pylist(), strict=True)]
            keep = [n for n in names if n != "_kind"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(rows, _PCM)], names=[*keep, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_kind"]
    struct = PCM_SCHEMA.replace(" ", ":").replace(",:", ",")
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` struct<{struct}>"]))


def encode_streams(df: DataFrame, kind: str, bits: int, rate: str = "sample_rate", channels: str = "channels", samples: str = "samples", out: str = "content") -> DataFrame:
    """Adds a WAV or FLAC file of each row's samples; rows that can't be coded get null and an ``error_code``."""
    if kind not in ("wav", "flac"):
        raise AudioError("UnsupportedFormat", kind)
    names = df.columns

    def one(r, c, s):
        try:
            pcm = Pcm(r or 0, c or 0, np.array(s if s is not None else [], np.float32))
            return (wav if kind == "wav" else flac).encode(pcm, bits), None
        except AudioError as e:
            return None, e.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(*row) for row in zip(*(batch.column(names.index(n)).to_pylist() for n in (rate, channels, samples)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=[*names, out, "error_code"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` binary", "error_code string"]))


class AudioSource(DataSource):
    """``spark.read.format("audio").load(folder)``: a row for each file of a local or mounted folder, decoded.

    For other stores, read with ``binaryFile`` and use ``decode_files``.
    """

    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        return "path string, " + PCM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AudioReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return AudioWriter(self.options, schema.names)


class AudioReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise AudioError("InvalidInput", "a path is needed")

    def partitions(self) -> list[InputPartition]:
        import os

        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names)
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            raw = f.read()
        row = decode_bytes(raw, sniff_bytes(raw))
        yield (partition.value, row["format"], row["sample_rate"], row["channels"], None if row["samples"] is None else [float(x) for x in row["samples"]], row["error_code"], row["error_detail"])


class AudioWriter(DataSourceWriter):
    """Writes rows of name, sample_rate, channels and samples as files of the folder; option ``kind`` says of which format.

    A file is written under another name and then renamed, so a task that is run again leaves whole files.
    """

    def __init__(self, options, names: list[str]):
        self.path, self.kind, self.names = options.get("path"), options.get("kind", "wav"), names
        if not self.path or not {"name", "sample_rate", "channels", "samples"} <= set(names):
            raise AudioError("InvalidInput", "a path, and columns name, sample_rate, channels and samples, are needed")

    def write(self, rows) -> WriterCommitMessage:
        import os

        from .lossy import encode

        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            whole = encode(self.kind, Pcm(r["sample_rate"], r["channels"], np.array(r["samples"], np.float32)))
            final = os.path.join(self.path, f"{os.path.basename(str(r['name']))}.{self.kind}")
            with open(f"{final}.{os.getpid()}.part", "wb") as f:
                f.write(whole)
            os.replace(f.name, final)
        return WriterCommitMessage()


def sniff_bytes(raw: bytes) -> str | None:
    """``containers.sniff`` for bytes at hand."""
    from .containers import BRANDS, OGG_HEAD

    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        return "wav"
    if raw[:4] == b"fLaC":
        return "flac"
    if raw[:4] == b"OggS":
        head = raw[:OGG_HEAD]
        return "opus" if b"OpusHead" in head else "vorbis" if b"vorbis" in head else None
    if raw[4:8] == b"ftyp":
        size = int.from_bytes(raw[:4], "big")
        end = len(raw) if size == 0 else min(size, len(raw))
        if any(raw[o : o + 4] in BRANDS for o in range(8, end - 3, 4) if o != 12):
            return "aac"
    if len(raw) >= 2 and raw[0] == 0xFF and raw[1] & 0xF6 == 0xF0:
        return "aac"
    if raw[:3] == b"ID3" or len(raw) >= 2 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0:
        return "mp3"
    return None


def to_adts(raw: bytes) -> bytes:
    """The ADTS stream of an AAC file of either container."""
    return demux_m4a(raw) if raw[4:8] == b"ftyp" else raw
