"""RIFF/WAVE files."""

from __future__ import annotations

import struct

import numpy as np

from .errors import AudioError, incomplete, invalid
from .pcm import Pcm, to_floats, to_integers


def decode(raw: bytes) -> Pcm:
    """8, 16, 24 and 32-bit integers and 32-bit floats; the first data chunk counts."""
    if len(raw) < 12:
        raise incomplete("header")
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise invalid("no RIFF/WAVE signature")
    end = 8 + int.from_bytes(raw[4:8], "little")
    if end < 12:
        raise invalid("RIFF size is too small")
    if end > len(raw):
        raise incomplete("RIFF data")
    at, chunks = 12, {}
    while at < end:
        if at + 8 > end:
            raise invalid("chunk header is cut off")
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise invalid("a chunk is larger than the file")
        body = raw[at + 8 : at + 8 + size]
        if name == b"data":
            chunks.setdefault(name, body)
        else:
            chunks[name] = body
        at += 8 + size + size % 2
    if b"fmt " not in chunks or b"data" not in chunks:
        raise invalid("a chunk is missing")
    return _samples(chunks[b"fmt "], chunks[b"data"])


def _samples(form: bytes, data: bytes) -> Pcm:
    if len(form) < 16:
        raise invalid("fmt chunk is cut off")
    kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", form[:16])
    if kind == 0xFFFE and len(form) >= 26:
        kind = int.from_bytes(form[24:26], "little")
    if not channels or not rate:
        raise invalid("no channels or no rate")
    width = bits // 8
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32)}:
        raise AudioError("UnsupportedFeature", f"sample format {kind} with {bits} bits")
    if align != channels * width or len(data) % align:
        raise invalid("frames are not whole")
    if kind == 3:
        return Pcm(rate, channels, np.frombuffer(data, "<f4"))
    if bits == 8:
        return Pcm(rate, channels, (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128)
    if bits == 24:
        octets = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        values = octets[:, 0] | octets[:, 1] << 8 | octets[:, 2] << 16
        values -= (values >> 23) << 24
    else:
        values = np.frombuffer(data, f"<i{width}").astype(np.int64)
    return Pcm(rate, channels, to_floats(values, bits))


def encode(pcm: Pcm, bits: int = 16) -> bytes:
    """16 or 24-bit integers, or 32 for floats kept as they are."""
    if bits == 32:
        kind, data = 3, pcm.samples.astype("<f4").tobytes()
    elif bits in (16, 24):
        octets = to_integers(pcm.samples, bits).astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]
        kind, data = 1, octets.tobytes()
    else:
        raise AudioError("UnsupportedFeature", f"{bits} bits")
    align = pcm.channels * bits // 8
    form = struct.pack("<HHIIHH", kind, pcm.channels, pcm.sample_rate, pcm.sample_rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data
