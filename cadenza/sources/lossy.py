"""The part of the lossy formats that needs no codec: streams of silence, and the rules of encoding by name."""

from __future__ import annotations

import numpy as np

from . import flac, wav
from .containers import AdtsFrame, MpegHeader, adts_frame, adts_frames, mpeg_frames, mux_m4a
from .errors import AudioError, invalid
from .files import to_adts
from .pcm import Pcm

#: Default bit rates in kbit/s of MPEG-1 and of the lower sampling rates, and the gain of a step of 1; fixed values of the format.
KBPS, LOW_KBPS, NEUTRAL_GAIN = 128, 64, 210


def is_silent(pcm: Pcm, eps: float = 0.0) -> bool:
    return bool((np.abs(pcm.samples) <= eps).all())


def _bits(*fields: tuple[int, int]) -> bytes:
    text = "".join(format(v, f"0{n}b") for v, n in fields)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def silent_side_info(mpeg1: bool, channels: int) -> bytes:
    """Layer III side information of granules without spectral data."""
    head = [(0, 9), (0, {1: 5, 2: 3}[channels]), (0, 4 * channels)] if mpeg1 else [(0, 8), (0, channels)]
    width = 4 if mpeg1 else 9
    tail = 3 if mpeg1 else 2
    one = [(0, 12), (0, 9), (NEUTRAL_GAIN, 8), (0, width), (0, 1), (0, 15), (0, 7), (0, tail)]
    return _bits(*head, *one * ((2 if mpeg1 else 1) * channels))


def encode_silent_mp3(pcm: Pcm) -> bytes:
    version = {44100: 3, 48000: 3, 32000: 3, 22050: 2, 24000: 2, 16000: 2}.get(pcm.sample_rate)
    if version is None or pcm.channels > 2:
        raise AudioError("InvalidPcm", "rate or channels")
    head = MpegHeader(version, 3, False, KBPS if version == 3 else LOW_KBPS, pcm.sample_rate, False, 3 if pcm.channels == 1 else 0, 0)
    body = head.to_bytes() + silent_side_info(version == 3, pcm.channels)
    return (body + bytes(head.length - len(body))) * -(-pcm.frames // head.samples)


def decode_silent_mp3(raw: bytes) -> Pcm:
    """MPEG-1 streams of silent frames of one format."""
    frames = mpeg_frames(raw)
    if not frames:
        raise invalid("no frames")
    first = frames[0][1]
    for at, h in frames:
        body = raw[at + (4 if not h.crc else 6) : at + h.length]
        side = silent_side_info(True, h.channels)
        if h.version != 3 or h.layer != 3 or body[: len(side)] != side or any(body[len(side) :]):
            raise AudioError("UnsupportedFeature", "only silent MPEG-1 Layer III is decoded")
        if (h.rate, h.channels) != (first.rate, first.channels):
            raise AudioError("UnsupportedFeature", "a change of parameters")
    return Pcm(first.rate, first.channels, np.zeros(1152 * len(frames) * first.channels, np.float32))


def silent_access_unit(channels: int) -> bytes:
    """A raw data block of one or two channels without spectral data."""
    channel = [(0, 8), (0, 1), (0, 2), (0, 1), (0, 6), (0, 1), (0, 1), (0, 1), (0, 1)]
    if channels == 1:
        return _bits((0, 3), (0, 4), *channel, (7, 3))
    if channels == 2:
        return _bits((1, 3), (0, 4), (0, 1), *channel, *channel, (7, 3))
    raise AudioError("UnsupportedFeature", f"{channels} channels")


def encode_silent_aac(pcm: Pcm) -> bytes:
    return adts_frame(silent_access_unit(pcm.channels), pcm.sample_rate, pcm.channels) * max(1, -(-pcm.frames // 1024))


def decode_silent_aac(raw: bytes) -> Pcm:
    frames: list[AdtsFrame] = adts_frames(to_adts(raw))
    if not frames:
        raise invalid("no frames")
    first = frames[0]
    if any(f.payload.rstrip(b"\0") != silent_access_unit(f.channels).rstrip(b"\0") or (f.rate, f.channels) != (first.rate, first.channels) for f in frames):
        raise AudioError("UnsupportedFeature", "only silent AAC-LC is decoded")
    return Pcm(first.rate, first.channels, np.zeros(1024 * len(frames) * first.channels, np.float32))


def rejection(kind: str, pcm: Pcm) -> str | None:
    """Why a stream can't be coded, or None."""
    if kind in ("wav", "flac"):
        return None
    if kind == "mp3":
        return None if is_silent(pcm) else "mp3 has no encoder here but for silence"
    if kind in ("aac", "m4a", "mp4"):
        return None if is_silent(pcm, 1e-8) else "aac has no encoder here but for silence"
    return f"{kind} has no encoder here"


def encode(kind: str, pcm: Pcm) -> bytes:
    """By name, whatever its case: 32-bit float WAV, 24-bit FLAC, and silence as MP3, AAC or M4A."""
    kind = kind.lower()
    if kind not in ("wav", "flac", "mp3", "aac", "m4a", "mp4", "vorbis", "opus"):
        raise AudioError("UnsupportedFormat", kind)
    reason = rejection(kind, pcm)
    if reason:
        raise AudioError("UnsupportedFeature", reason)
    if kind == "wav":
        return wav.encode(pcm, 32)
    if kind == "flac":
        return flac.encode(pcm, 24)
    if kind == "mp3":
        return encode_silent_mp3(pcm)
    adts = encode_silent_aac(pcm)
    return adts if kind == "aac" else mux_m4a(adts)
