"""Chunks of streams, buffered until a whole stream decodes.

A chunk is added to its stream's bytes and the whole is decoded: a result or a
hard error clears the buffer, an incomplete stream waits for more, an empty chunk
on an empty buffer gives nothing, and a buffer over the cap is cleared with an
error.  ``decode_chunks`` does this for a table of ordered chunks, and for a
stream of them with the buffer as state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.errors import AudioError
from ..sources.files import decode_bytes, sniff_bytes

CAP = 64 << 20
SCHEMA = "{key} string, seq long, status string, format string, sample_rate int, channels int, frames long, buffered long"


def audio(raw: bytes) -> dict:
    """Decodes a file; raises AudioError, with code Incomplete if more bytes may help."""
    kind = sniff_bytes(raw)
    if kind is None:
        raise AudioError("Incomplete" if len(raw) < 12 else "UnsupportedFormat")
    row = decode_bytes(raw, kind)
    if row["error_code"]:
        raise AudioError(row["error_code"], row["error_detail"] or "")
    return {"format": kind, "sample_rate": row["sample_rate"], "channels": row["channels"], "frames": len(row["samples"]) // row["channels"]}


def flac(raw: bytes) -> dict:
    """FLAC alone: whatever ends too soon is incomplete, another signature is an error."""
    if raw[:4] != b"fLaC"[: len(raw)]:
        raise AudioError("UnsupportedFormat")
    row = decode_bytes(raw, "flac")
    if row["error_code"]:
        raise AudioError("Incomplete" if row["error_code"] in ("Incomplete", "InvalidInput") else row["error_code"], row["error_detail"] or "")
    return {"format": "flac", "sample_rate": row["sample_rate"], "channels": row["channels"], "frames": len(row["samples"]) // row["channels"]}


def push(pending: bytes, chunk: bytes, decode: Callable[[bytes], dict], cap: int = CAP) -> tuple[bytes, str | None, dict]:
    """One step: the bytes still pending, the status (none, decoded, waiting or an error code), and the result."""
    if not pending and not chunk:
        return b"", None, {}
    whole = pending + chunk
    if len(whole) > cap:
        return b"", "InvalidInput", {}
    try:
        return b"", "decoded", decode(whole)
    except AudioError as e:
        return (whole, "waiting", {}) if e.code == "Incomplete" else (b"", e.code, {})


def decode_chunks(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk", decode: Callable[[bytes], dict] = audio, cap: int = CAP, reset: str | None = None) -> DataFrame:
    """A row for each chunk with a status.  A table's chunks go in order of ``seq``, a stream's as they arrive.

    Where the column ``reset`` holds, what is pending is dropped before the chunk.
    """
    fresh = F.coalesce(F.col(reset).cast("boolean"), F.lit(False)) if reset else F.lit(False)
    ordered = chunks.select(F.col(key).cast("string").alias(key), F.col(seq).cast("long").alias("seq"), F.col(chunk).cast("binary").alias("chunk"), fresh.alias("fresh"))
    schema = SCHEMA.format(key=f"`{key}`")

    def steps(name: str, rows: pd.DataFrame, pending: bytes) -> tuple[pd.DataFrame, bytes]:
        out = []
        for r in rows.sort_values("seq", kind="stable").itertuples():
            pending, status, found = push(b"" if r.fresh else pending, bytes(r.chunk) if r.chunk is not None else b"", decode, cap)
            if status is not None:
                out.append((name, r.seq, status, found.get("format"), found.get("sample_rate"), found.get("channels"), found.get("frames"), len(pending)))
        frame = pd.DataFrame(out, columns=[key, "seq", "status", "format", "sample_rate", "channels", "frames", "buffered"])
        return frame.astype({"sample_rate": "Int32", "channels": "Int32", "frames": "Int64"}), pending

    if not chunks.isStreaming:
        return ordered.groupBy(key).applyInPandas(lambda k, rows: steps(k[0], rows, b"")[0], schema)

    def stateful(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = bytes(state.get[0]) if state.exists else b""
        out, pending = steps(k[0], pd.concat(list(batches)), pending)
        if pending:
            state.update((pending,))
        elif state.exists:
            state.remove()
        yield out

    return ordered.groupBy(key).applyInPandasWithState(stateful, schema, "pending binary", "append", GroupStateTimeout.NoTimeout)
