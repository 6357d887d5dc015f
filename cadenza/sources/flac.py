"""FLAC streams (RFC 9639): all subframe kinds read; fixed predictors with one Rice partition written."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from ..functions.checksums import crc8, crc16
from .errors import AudioError, incomplete, invalid
from .pcm import Pcm, to_floats, to_integers

BLOCK = 4096
#: Sampling rates, sample sizes and block sizes by code; fixed values of the format.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class BitReader:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at, self.end = raw, at * 8, len(raw) * 8

    def bits(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.end:
            raise incomplete("bits")
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.raw[lo:hi], "big") >> (hi * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        """Zeros before the next one."""
        n = 0
        while True:
            if self.at >= self.end:
                raise incomplete("bits")
            rest = 8 - (self.at & 7)
            byte = self.raw[self.at >> 3] & ((1 << rest) - 1)
            if byte:
                zeros = rest - byte.bit_length()
                self.at += zeros + 1
                return n + zeros
            n += rest
            self.at += rest

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


@dataclass
class StreamInfo:
    min_block: int
    max_block: int
    min_frame: int
    max_frame: int
    rate: int
    channels: int
    depth: int
    total: int
    md5: bytes


def stream_info(raw: bytes) -> tuple[StreamInfo, int]:
    """STREAMINFO and where the frames begin."""
    if len(raw) < 4:
        raise incomplete("marker")
    if raw[:4] != b"fLaC":
        raise invalid("no fLaC marker")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(raw):
            raise incomplete("metadata")
        last, kind, size = bool(raw[at] >> 7), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if len(body) < size:
            raise incomplete("metadata")
        if kind == 0:
            if info is not None or size < 34:
                raise invalid("STREAMINFO")
            packed = int.from_bytes(body[10:18], "big")
            info = StreamInfo(*(int.from_bytes(body[a:b], "big") for a, b in ((0, 2), (2, 4), (4, 7), (7, 10))), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), body[18:34])
        elif info is None:
            raise invalid("STREAMINFO is not first")
        at += 4 + size
    if info is None or not info.rate:
        raise invalid("STREAMINFO")
    return info, at


def _coded_number(r: BitReader) -> int:
    first = r.bits(8)
    extra = 0
    while first & (0x80 >> extra):
        extra += 1
    if extra == 0:
        return first
    if extra == 1 or extra > 7:
        raise invalid("coded number")
    value = first & (0x7F >> extra)
    for _ in range(extra - 1):
        b = r.bits(8)
        if b >> 6 != 2:
            raise invalid("coded number")
        value = value << 6 | b & 63
    return value


def _residual(r: BitReader, block: int, order: int) -> np.ndarray:
    method, partition_order = r.bits(2), r.bits(4)
    if method > 1 or block % (1 << partition_order) or (block >> partition_order) < order:
        raise invalid("residual")
    width, out = 4 + method, []
    for p in range(1 << partition_order):
        n, k = (block >> partition_order) - (order if p == 0 else 0), r.bits(width)
        if k == (1 << width) - 1:
            raw = r.bits(5)
            out += [r.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                f = r.unary() << k | r.bits(k)
                out.append(-(f >> 1) - 1 if f & 1 else f >> 1)
    return np.array(out, np.int64)


def _predicted(warm: list[int], residual: np.ndarray, taps: list[int], shift: int) -> np.ndarray:
    out = [*warm, *residual.tolist()]
    for i in range(len(warm), len(out)):
        out[i] += sum(c * out[i - 1 - j] for j, c in enumerate(taps)) >> shift
    return np.array(out, np.int64)


#: Predictor taps of the fixed orders, most recent sample first; fixed values of the format.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(r: BitReader, block: int, depth: int) -> np.ndarray:
    if r.bits(1):
        raise invalid("subframe")
    kind, wasted = r.bits(6), 0
    if r.bits(1):
        wasted = r.unary() + 1
        depth -= wasted
    if depth < 1:
        raise invalid("subframe")
    if kind == 0:
        out = np.full(block, r.signed(depth), np.int64)
    elif kind == 1:
        out = np.array([r.signed(depth) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        if order > block:
            raise invalid("predictor order")
        warm = [r.signed(depth) for _ in range(order)]
        taps, shift = list(FIXED[order]) if kind <= 12 else [], 0
        if kind >= 32:
            precision = r.bits(4) + 1
            shift = r.signed(5)
            if precision == 16 or shift < 0:
                raise invalid("predictor")
            taps = [r.signed(precision) for _ in range(order)]
        residual = _residual(r, block, order)
        if kind <= 12:
            out = residual.copy()
            for k in range(order, 0, -1):  # undo one difference at a time
                start = np.array(warm)
                for _ in range(k - 1):
                    start = np.diff(start)
                out = np.cumsum(np.concatenate([start[-1:], out]))[1:]
            out = np.concatenate([np.array(warm, np.int64), out])
        else:
            out = _predicted(warm, residual, taps, shift)
    else:
        raise invalid("subframe")
    return out << wasted


def _frame(raw: bytes, at: int, info: StreamInfo) -> tuple[np.ndarray, int, int, bool]:
    """Samples by channel, where the next frame begins, the coded number, and whether blocks are fixed."""
    r = BitReader(raw, at)
    if r.bits(15) != 0x7FFC:
        raise invalid("frame sync")
    fixed = not r.bits(1)
    size, rate, assignment, depth = r.bits(4), r.bits(4), r.bits(4), r.bits(3)
    if r.bits(1) or not size or rate == 15 or assignment > 10 or depth == 3:
        raise invalid("frame header")
    number = _coded_number(r)
    if size == 1:
        block = 192
    elif size in (6, 7):
        block = r.bits(8 * (size - 5)) + 1
    else:
        block = 576 << (size - 2) if size < 6 else 256 << (size - 8)
    if rate in (12, 13, 14):
        r.bits(8 if rate == 12 else 16)
    if crc8(raw[at : r.at >> 3]) != r.bits(8):
        raise invalid("frame header checksum")
    bits = DEPTHS.get(depth, info.depth)
    channels = assignment + 1 if assignment < 8 else 2
    if channels != info.channels or bits != info.depth:
        raise invalid("a frame differs from STREAMINFO")
    wide = {8: 1, 9: 0, 10: 1}.get(assignment)
    x = [_subframe(r, block, bits + (c == wide)) for c in range(channels)]
    if assignment == 8:
        x[1] = x[0] - x[1]
    elif assignment == 9:
        x[0] = x[0] + x[1]
    elif assignment == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    r.align()
    end = r.at >> 3
    if crc16(raw[at:end]) != r.bits(16):
        raise invalid("frame checksum")
    return np.stack(x, axis=1), end + 2, number, fixed


def _md5(values: np.ndarray, depth: int) -> bytes:
    width = -(-depth // 8)
    return hashlib.md5(values.reshape(-1).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()).digest()


def decode(raw: bytes) -> Pcm:
    info, at = stream_info(raw)
    parts, done = [], 0
    while at < len(raw):
        x, at, number, fixed = _frame(raw, at, info)
        if number != (len(parts) if fixed else done):
            raise invalid("frame number")
        if info.max_block and len(x) > info.max_block:
            raise invalid("block size")
        parts.append(x)
        done += len(x)
        if info.total and done > info.total:
            raise invalid("more samples than STREAMINFO has")
    if not parts or info.total and done < info.total:
        raise incomplete("audio frames")
    values = np.concatenate(parts)
    if any(info.md5) and _md5(values, info.depth) != info.md5:
        raise invalid("MD5")
    return Pcm(info.rate, info.channels, to_floats(values.reshape(-1), info.depth))


class BitWriter:
    """Collects (value, width) pairs and packs them at once."""

    def __init__(self):
        self.values, self.widths = [], []

    def put(self, values, widths) -> None:
        self.values.append(np.atleast_1d(np.asarray(values, np.int64)))
        self.widths.append(np.broadcast_to(np.asarray(widths, np.int64), self.values[-1].shape))

    def bit_count(self) -> int:
        return int(sum(w.sum() for w in self.widths))

    def packed(self) -> bytes:
        v, w = np.concatenate(self.values), np.concatenate(self.widths)
        ends = np.cumsum(w)
        down = np.repeat(ends - 1, w) - np.arange(int(ends[-1]))
        return np.packbits(((np.repeat(v, w) >> down) & 1).astype(np.uint8)).tobytes()


def _write_subframe(out: BitWriter, x: np.ndarray, depth: int) -> None:
    mask = (1 << depth) - 1
    if (x == x[0]).all():
        out.put([0, x[0] & mask], [8, depth])
        return
    best = None
    for order in range(1, min(4, len(x)) + 1):
        d = np.diff(x, order)
        f = np.where(d < 0, -2 * d - 1, 2 * d)
        for k in range(15):
            cost = 18 + order * depth + int((f >> k).sum()) + len(f) * (1 + k)
            if best is None or cost < best[0]:
                best = cost, order, k, f
    if best is None or best[0] >= 8 + len(x) * depth:
        out.put(2, 8)
        out.put(x & mask, depth)
        return
    _, order, k, f = best
    out.put((8 + order) << 1, 8)
    out.put(x[:order] & mask, depth)
    out.put([0, 0, k], [2, 4, 4])
    high = f >> k
    # A code is its zeros, a one, and the low bits; wide ones are cut so that values fit a word.
    width = high + 1 + k
    value = (1 << k) | (f & ((1 << k) - 1))
    spare = np.maximum(width - 48, 0)
    pairs = np.stack([np.zeros_like(value), value], axis=1).reshape(-1)
    out.put(pairs, np.stack([spare, width - spare], axis=1).reshape(-1))


def _coded(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    extra = 1
    while n >= 1 << (6 * extra + 6 - extra):
        extra += 1
    head = (0xFF << (7 - extra)) & 0xFF | n >> (6 * extra)
    return bytes([head, *(0x80 | n >> (6 * i) & 63 for i in range(extra - 1, -1, -1))])


def _write_frame(x: np.ndarray, number: int, depth: int) -> bytes:
    """Of two channels the shortest of left/right, left/side, side/right and mid/side, the first of equal ones."""
    n, channels = x.shape
    plans = [(channels - 1, [(x[:, c], depth) for c in range(channels)])]
    if channels == 2:
        left, right = x[:, 0], x[:, 1]
        side, mid = left - right, (left + right) >> 1
        plans += [(8, [(left, depth), (side, depth + 1)]), (9, [(side, depth + 1), (right, depth)]), (10, [(mid, depth), (side, depth + 1)])]
    best = b""
    for assignment, parts in plans:
        head = bytes([0xFF, 0xF8, 0x70, assignment << 4 | {16: 8, 24: 12}[depth]]) + _coded(number) + (n - 1).to_bytes(2, "big")
        out = BitWriter()
        for values, bits in parts:
            _write_subframe(out, values, bits)
        body = head + bytes([crc8(head)]) + out.packed()
        if not best or len(body) < len(best):
            best = body
    return best + crc16(best).to_bytes(2, "big")


def encode(pcm: Pcm, bits: int = 16) -> bytes:
    if bits not in (16, 24):
        raise AudioError("UnsupportedFeature", f"{bits} bits")
    if not pcm.frames or pcm.sample_rate >= 1 << 20 or pcm.channels > 8:
        raise AudioError("InvalidPcm", "frames, rate or channels")
    values = to_integers(pcm.samples, bits).reshape(-1, pcm.channels)
    blocks = [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]
    frames = [_write_frame(b, i, bits) for i, b in enumerate(blocks)]
    least = min(len(b) for b in blocks[: max(1, len(blocks) - 1)])
    sizes = [len(f) for f in frames]
    packed = pcm.sample_rate << 44 | (pcm.channels - 1) << 41 | (bits - 1) << 36 | len(values)
    info = least.to_bytes(2, "big") + max(len(b) for b in blocks).to_bytes(2, "big") + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + _md5(values, bits)
    return b"fLaC\x80\x00\x00\x22" + info + b"".join(frames)
