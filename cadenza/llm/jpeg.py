"""Progressive JPEG in numpy, many images at a time.

The decoder accumulates the scans of a progressive file into coefficient arrays:
spectral selection fills bands, successive approximation adds bits.  All entropy-
coded segments (between restart markers) of a batch that belong to like scans are
decoded in lockstep, one coefficient position after another, so files with many
restart markers, or many files, decode by vector operations.  Coefficients are
then dequantised, inverse-transformed, upsampled and turned into RGB.

The encoder writes progressive files from coefficients, with fixed code tables
and a restart marker after each MCU.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from .text import ragged

#: Raster index of each coefficient in zigzag order, by the rule of the diagonals.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_k, _n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_BASIS = np.where(_k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _n + 1) * _k * np.pi / 16)
#: 64 zigzag coefficients to 64 samples in raster order.
INVERSE = np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG]
#: The same in whole numbers, whose sums are exact in any order: samples don't depend on what else is in a batch.
SCALE = 1 << 20
_WHOLE = np.rint(INVERSE * SCALE)


# --- code tables ---------------------------------------------------------------


@dataclass
class Codes:
    """A canonical code table: symbols in order of code, and how many have 1 to 16 bits."""

    symbols: bytes
    counts: bytes

    def __post_init__(self):
        self.length, self.code = np.zeros(256, np.int64), np.zeros(256, np.int64)
        symbol = np.zeros(1 << 16, np.uint8)
        length = np.zeros(1 << 16, np.uint8)
        code, at = 0, 0
        for bits, count in enumerate(self.counts, 1):
            for s in self.symbols[at : at + count]:
                self.length[s], self.code[s] = bits, code
                symbol[code << (16 - bits) : (code + 1) << (16 - bits)] = s
                length[code << (16 - bits) : (code + 1) << (16 - bits)] = bits
                code += 1
            at += count
            code <<= 1
        self.lookup_symbol, self.lookup_length = symbol, length

    @classmethod
    def of(cls, lengths: dict[int, int]) -> Codes:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        return cls(bytes(order), bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17)))


def _tables() -> dict[str, Codes]:
    first = {size: 3 for size in range(1, 8)} | {0x00: 5, 0xF0: 10}
    first |= {run << 4 | size: 11 for run in range(16) for size in range(1, 11) if (run << 4 | size) not in first}
    first |= {run << 4: 12 for run in range(1, 15)}
    refine = {0x00: 2, 0x01: 2, 0x11: 3, 0x21: 4, 0x31: 5, 0x41: 6, 0x51: 7}
    refine |= {s: 10 for s in (*(r << 4 | 1 for r in range(6, 16)), *(r << 4 for r in range(1, 16)))}
    return {"dc": Codes.of({s: 4 for s in range(12)}), "first": Codes.of(first), "refine": Codes.of(refine)}


TABLES = _tables()
#: (first, last, high bit, low bit) of each scan; a refined band has at most 15 coefficients.
SCRIPT = ((0, 0, 0, 1), (1, 15, 0, 1), (16, 63, 0, 0), (0, 0, 1, 0), (1, 15, 1, 0))


# --- encoder -------------------------------------------------------------------


def _bit_size(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _extra(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(x < 0, x + (1 << size) - 1, x)


def _pack(block: np.ndarray, code: np.ndarray, length: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in order of block, as bytes; each block starts a byte and is filled with ones."""
    bits = np.bincount(block, length, blocks).astype(np.int64)
    size = (bits + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    before = np.cumsum(length) - length
    lead = np.concatenate([[0], np.cumsum(bits)])
    at = start[block] * 8 + before - lead[block]
    out = np.ones(int(start[-1]) * 8, np.uint8)
    down = np.repeat(before + length - 1, length) - np.arange(int(length.sum()))
    out[ragged(at, length)] = (np.repeat(code, length) >> down) & 1
    return np.packbits(out), start


def _ac_first(x: np.ndarray, last: int, table: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = x.shape
    shown = np.ones((n, width + 1), bool)
    shown[:, :width] = x != 0
    shown[:, width] = x[:, -1] == 0  # an end of block is needed
    row, col = np.nonzero(shown)
    before = np.concatenate([[-1], col[:-1]])
    before[np.concatenate([[True], row[1:] != row[:-1]])] = -1
    ends = col == width
    run = np.where(ends, 0, col - before - 1)
    value = np.where(ends, 0, x[row, np.minimum(col, width - 1)])
    size = _bit_size(value)
    long_runs = run >> 4
    at = np.cumsum(long_runs + 1) - 1
    total = int(at[-1]) + 1 if len(at) else 0
    code, length = np.full(total, table.code[0xF0]), np.full(total, table.length[0xF0])
    symbol = (run & 15) << 4 | size
    code[at] = table.code[symbol] << size | _extra(value, size)
    length[at] = table.length[symbol] + size
    return np.repeat(row, long_runs + 1), code, length


def _ac_refine(x: np.ndarray, low: int, table: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = x.shape
    size = np.abs(x) >> low
    fresh, old = size == 1, size > 1
    group = np.cumsum(fresh, axis=1) - fresh  # symbols before each coefficient
    col = np.arange(width)
    row_n, col_n = np.nonzero(fresh)
    zero_before = np.cumsum(size == 0, axis=1)
    zeros = zero_before[row_n, col_n]
    lead = np.concatenate([[0], zeros[:-1]])
    lead[np.concatenate([[True], row_n[1:] != row_n[:-1]])] = 0
    symbol = (zeros - lead) << 4 | 1
    new = (row_n, group[row_n, col_n], np.full(len(row_n), -1), table.code[symbol] << 1 | (x[row_n, col_n] > 0), table.length[symbol] + 1)
    row_e = np.flatnonzero(~fresh[:, -1])
    end = (row_e, fresh[row_e].sum(axis=1), np.full(len(row_e), -1), np.full(len(row_e), table.code[0]), np.full(len(row_e), table.length[0]))
    row_c, col_c = np.nonzero(old)
    fix = (row_c, group[row_c, col_c], col[col_c], size[row_c, col_c] & 1, np.ones(len(row_c), np.int64))
    row, part, place, code, length = (np.concatenate(c) for c in zip(new, end, fix, strict=True))
    order = np.argsort((row * (width + 1) + part) * (width + 2) + place, kind="stable")
    return row[order], code[order], length[order]


def _marked(data: np.ndarray, start: np.ndarray, images: np.ndarray, restarts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stuffs bytes and sets restart markers between the blocks of an image; images: n + 1 block offsets."""
    blocks = len(start) - 1
    stuffed = (data == 0xFF).astype(np.int64)
    last = np.zeros(blocks, bool)
    last[images[1:][np.diff(images) > 0] - 1] = True
    mark = np.where(last, 0, 2) if restarts else np.zeros(blocks, np.int64)
    marks_before = np.concatenate([[0], np.cumsum(mark)])
    at = np.arange(len(data)) + np.cumsum(stuffed) - stuffed + np.repeat(marks_before[:-1], np.diff(start))
    stuffed_before = np.concatenate([[0], np.cumsum(stuffed)])
    bounds = start + stuffed_before[start] + marks_before
    out = np.zeros(int(bounds[-1]), np.uint8)
    out[at] = data
    if restarts:
        place = np.arange(blocks) - np.repeat(images[:-1], np.diff(images))
        where = bounds[1:][~last] - 2
        out[where], out[where + 1] = 0xFF, 0xD0 + place[~last] % 8
    return out, bounds[images]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code_table(kind: int, slot: int, codes: Codes) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot]) + codes.counts + codes.symbols)


def encode_gray(coefficients: np.ndarray, images: np.ndarray, sizes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Files of one component with quantiser 1.

    coefficients: (blocks, 64) in zigzag order, of all images in a row; images: n + 1
    block offsets; sizes: width and height in samples.
    """
    parts: list[list[bytes]] = []
    tables = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _code_table(0, 0, TABLES["dc"]) + _code_table(1, 0, TABLES["first"]) + _code_table(1, 1, TABLES["refine"])
    for (width, height), comment in zip(sizes, comments, strict=True):
        parts.append([b"\xff\xd8", _segment(0xFE, comment), tables, _segment(0xC2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))])
    rows = np.arange(len(coefficients))
    for first, last, high, low in SCRIPT:
        band = coefficients[:, first : last + 1].astype(np.int64)
        if first == 0 and high:
            bits = (band[:, 0] >> low) & 1
            image = np.repeat(np.arange(len(images) - 1), np.diff(images))
            data, start = _pack(image, bits, np.ones(len(bits), np.int64), len(images) - 1)
            data, bounds = _marked(data, start, np.arange(len(images)), False)
        else:
            if first == 0:
                value = band[:, 0] >> low  # each block begins after a restart, so the prediction is 0
                size = _bit_size(value)
                items = rows, TABLES["dc"].code[size] << size | _extra(value, size), TABLES["dc"].length[size] + size
            elif high:
                items = _ac_refine(band, low, TABLES["refine"])
            else:
                items = _ac_first(np.sign(band) * (np.abs(band) >> low), last, TABLES["first"])
            data, start = _pack(*items, len(coefficients))
            data, bounds = _marked(data, start, images, True)
        head = _segment(0xDD, struct.pack(">H", 0 if first == 0 and high else 1))
        head += _segment(0xDA, bytes([1, 1, 0x01 if high and first else 0x00, first, last, high << 4 | low]))
        whole = data.tobytes()
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            parts[i] += [head, whole[a:b]]
    return [b"".join(p) + b"\xff\xd9" for p in parts]


#: Luma is twice as wide as chroma: an MCU is two luma blocks and one of each chroma component.
SHARES = (2, 1, 1)
MCU = sum(SHARES)


def encode_colour(coefficients: np.ndarray, images: np.ndarray, sizes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Files of luma and two chroma components of half its width, with quantiser 1.

    coefficients: (blocks, 64) in zigzag order, of all images in a row, each its luma, then
    its chroma blocks; images: n + 1 block offsets; sizes: width and height in samples, of
    whole MCUs (16 by 8).
    """
    parts: list[list[bytes]] = []
    tables = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _code_table(0, 0, TABLES["dc"]) + _code_table(1, 0, TABLES["first"]) + _code_table(1, 1, TABLES["refine"])
    shape = bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    for (width, height), comment in zip(sizes, comments, strict=True):
        parts.append([b"\xff\xd8", _segment(0xFE, comment), tables, _segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + shape)])
    n, mcus = len(images) - 1, np.diff(images) // MCU
    planes = np.concatenate([[0], np.cumsum((mcus[:, None] * np.array(SHARES)).ravel())])
    at = np.concatenate([[0], np.cumsum(mcus)])
    place = ragged(np.zeros(n, np.int64), mcus)
    first_of = lambda c: np.repeat(planes[c:-1:3], mcus) + place * SHARES[c]
    order = np.stack([first_of(0), first_of(0) + 1, first_of(1), first_of(2)], 1)
    for first, last, high, low in SCRIPT:
        if first == 0:
            # All components together, MCU by MCU.
            dc = coefficients[:, 0].astype(np.int64)[order]
            if high:
                image = np.repeat(np.arange(n), mcus * MCU)
                data, start = _pack(image, (dc.ravel() >> low) & 1, np.ones(dc.size, np.int64), n)
                data, bounds = _marked(data, start, np.arange(n + 1), False)
            else:
                value = dc >> low
                value[:, 1] -= value[:, 0]  # each MCU begins after a restart, so other predictions are 0
                value = value.ravel()
                size = _bit_size(value)
                data, start = _pack(np.repeat(np.arange(len(dc)), MCU), TABLES["dc"].code[size] << size | _extra(value, size), TABLES["dc"].length[size] + size, len(dc))
                data, bounds = _marked(data, start, at, True)
            head = _segment(0xDD, struct.pack(">H", 0 if high else 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, high << 4 | low]))
            whole = data.tobytes()
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                parts[i] += [head, whole[a:b]]
            continue
        band = coefficients[:, first : last + 1].astype(np.int64)
        items = _ac_refine(band, low, TABLES["refine"]) if high else _ac_first(np.sign(band) * (np.abs(band) >> low), last, TABLES["first"])
        data, start = _pack(*items, len(coefficients))
        data, bounds = _marked(data, start, planes, True)
        whole, every = data.tobytes(), _segment(0xDD, struct.pack(">H", 1))
        heads = [every + _segment(0xDA, bytes([1, c, 0x01 if high else 0x00, first, last, high << 4 | low])) for c in (1, 2, 3)]
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            parts[k // 3] += [heads[k % 3], whole[a:b]]
    return [b"".join(p) + b"\xff\xd9" for p in parts]


# --- decoder -------------------------------------------------------------------


@dataclass
class Component:
    name: int
    h: int
    v: int
    quantiser: int
    columns: int = 0  # blocks in a row of the array, with padding to whole MCUs
    rows: int = 0
    shown_columns: int = 0  # blocks in a row of a scan of this component alone
    shown_rows: int = 0
    base: int = 0  # of its blocks among those of the batch


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    blocks: np.ndarray | None = None  # set when decoded: (blocks, 64)

    def frame(self, base: int) -> int:
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        across, down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        for c in self.components:
            c.columns, c.rows, c.base = across * c.h, down * c.v, base
            c.shown_columns, c.shown_rows = -(-self.width * c.h // (8 * h)), -(-self.height * c.v // (8 * v))
            base += c.columns * c.rows
        return base


@dataclass
class Scan:
    """A scan of an image: its blocks in order of decoding, as (MCUs, blocks of an MCU), and its segments."""

    order: np.ndarray
    starts: np.ndarray
    interval: int


def _order(components: list[Component]) -> np.ndarray:
    if len(components) == 1:
        c = components[0]
        return (c.base + np.arange(c.shown_rows)[:, None] * c.columns + np.arange(c.shown_columns)[None, :]).reshape(-1, 1)
    across, down = components[0].columns // components[0].h, components[0].rows // components[0].v
    mcus = []
    for c in components:
        y = (np.arange(down)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None]) * c.columns
        x = np.arange(across)[None, :, None, None] * c.h + np.arange(c.h)[None, None, None, :]
        mcus.append((c.base + y + x).reshape(across * down, c.h * c.v))
    return np.concatenate(mcus, axis=1)


class _Bits:
    """Reads bits of many segments at once; past the data come zeros."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(data) + 1
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + n] << np.uint64(56 - 8 * k) if k < 8 else 0
        self.at = at.astype(np.int64) * 8
        self.most = len(data)

    def peek(self) -> np.ndarray:
        """The next 32 bits."""
        byte = np.minimum(self.at >> 3, self.most)
        return ((self.words[byte] >> (32 - (self.at & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _symbols(bits: _Bits, table: Codes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next symbol of the segments wanted, read; and the 16 bits after it."""
    window = bits.peek()
    code = window >> 16
    symbol = np.where(wanted, table.lookup_symbol[code], 0).astype(np.int64)
    length = np.where(wanted, table.lookup_length[code], 0).astype(np.int64)
    bits.at += length
    return symbol, (window >> (16 - length)) & 0xFFFF


def _value(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = raw >> (16 - size)
    return np.where((size > 0) & (x < (1 << np.maximum(size - 1, 0))), x - (1 << size) + 1, x)


def _dc_first(out: np.ndarray, bits: _Bits, blocks: list[np.ndarray], tables: list[Codes], slots: list[int], low: int) -> None:
    """blocks: for each step the block of each segment, or -1; slots: the component of each step."""
    before = np.zeros((len(bits.at), max(slots) + 1), np.int64)
    for where, table, slot in zip(blocks, tables, slots, strict=True):
        live = where >= 0
        size, raw = _symbols(bits, table, live)
        bits.at += size
        before[:, slot] += _value(raw, size)
        out[where[live], 0] = (before[:, slot] << low)[live]


def _ac(out: np.ndarray, bits: _Bits, blocks: list[np.ndarray], table: Codes, first: int, last: int, high: int, low: int) -> None:
    left = np.zeros(len(bits.at), np.int64)  # blocks that an end-of-band run still covers
    for where in blocks:
        live = where >= 0
        row = np.where(live, where, 0)
        over = live & (left > 0)
        left -= over
        need, run, value = live & ~over, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        going = need.copy()  # not past the end of band
        for k in range(first, last + 1):
            want = need & going
            if want.any():
                symbol, raw = _symbols(bits, table, want)
                r, s = symbol >> 4, symbol & 15
                ends = want & (s == 0) & (r < 15)
                bits.at += np.where(ends, r, s)
                left += np.where(ends, (1 << r) + (raw >> (16 - r)) - 1, 0)
                going &= ~ends
                run = np.where(want, r, run)
                value = np.where(want, _value(raw, s), value)
                need &= ~want
            if high:
                now = out[row, k].astype(np.int64)
                old = live & (now != 0)
                bit = (bits.peek() >> 31) & old
                bits.at += old
                fresh = going & ~old
                here = fresh & (run == 0)
                put = np.where(old & (bit > 0) & ((np.abs(now) >> low & 1) == 0), now + np.sign(now) * (1 << low), now)
                put = np.where(here & (value != 0), np.where(value > 0, 1 << low, -(1 << low)), put)
                out[row[live], k] = put[live]
                run -= fresh & (run > 0)
                need |= here
            else:
                here = going & (run == 0)
                put = here & (value != 0)
                out[row[put], k] = np.sign(value[put]) * (np.abs(value[put]) << low)
                run -= going & (run > 0)
                need |= here


def _parsed(raw: bytes, image: Image, base: int) -> tuple[int, list]:
    """Headers into the image; scans as (key, tables, Scan with byte positions)."""
    codes: dict[int, Codes] = {}
    orders: dict[bytes, np.ndarray] = {}
    interval, at, scans = 0, 2, []
    view = np.frombuffer(raw, np.uint8)
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    ff = np.flatnonzero((view[:-1] == 0xFF) & (view[1:] != 0) & (view[1:] != 0xFF))
    kind = view[ff + 1]
    others = ff[(kind < 0xD0) | (kind > 0xD7)]
    restarts = ff[(kind >= 0xD0) & (kind <= 0xD7)]
    while True:
        while at + 1 < len(raw) and raw[at] == 0xFF and raw[at + 1] == 0xFF:
            at += 1
        if at + 3 >= len(raw) or raw[at + 1] == 0xD9:
            break
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _known(body[17 : 17 + n], body[1:17])
                body = body[17 + n :]
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            base = image.frame(base)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman-coded JPEG file")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            names = {c.name: c for c in image.components}
            chosen = [names[body[1 + 2 * i]] for i in range(body[0])]
            tables = [body[2 + 2 * i] for i in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = others[np.searchsorted(others, at)] if len(others) and others[-1] >= at else len(raw)
            inside = restarts[np.searchsorted(restarts, at) : np.searchsorted(restarts, end)]
            starts = np.concatenate([[at], inside + 2])
            if (shape := bytes(c.name for c in chosen)) not in orders:
                orders[shape] = _order(chosen)
            order = orders[shape]
            used = [codes.get(t >> 4) if first == 0 else codes.get(0x10 | t & 15) for t in tables]
            pattern = tuple(i for i, c in enumerate(chosen) for _ in range(c.h * c.v if len(chosen) > 1 else 1))
            key = (first, last, bits >> 4, bits & 15, pattern, tuple(id(c) for c in used))
            scans.append((key, used, Scan(order, starts, interval or len(order)), (at, int(end)), [c.name for c in chosen]))
            at = int(end)
    return base, scans


_tables_known: dict[tuple[bytes, bytes], Codes] = {}


def _known(symbols: bytes, counts: bytes) -> Codes:
    if (symbols, counts) not in _tables_known:
        if len(_tables_known) > 256:
            _tables_known.clear()
        _tables_known[symbols, counts] = Codes(symbols, counts)
    return _tables_known[symbols, counts]


def decode(files: list[bytes]) -> list[Image]:
    """Coefficients of all files; scans of like kind are decoded together."""
    images, base, steps = [], 0, []
    keep = []  # code tables, so that their identities last
    for raw in files:
        image = Image()
        base, scans = _parsed(raw, image, base)
        images.append(image)
        ready: dict[tuple[int, bool], int] = {}  # the step after the last one of a component's DC or AC
        for scan in scans:
            mine = [(int(c), scan[0][0] > 0) for c in scan[4]]
            k = max(ready.get(m, 0) for m in mine)
            ready |= dict.fromkeys(mine, k + 1)
            keep.append(scan[1])
            while len(steps) <= k:
                steps.append({})
            steps[k].setdefault(scan[0], []).append((raw, scan))
    out = np.zeros((base, 64), np.int32)
    for step in steps:
        for (first, last, high, low, pattern, _), group in step.items():
            _run_scan(out, group, first, last, high, low, pattern)
    for image in images:
        lo = image.components[0].base if image.components else 0
        hi = lo + sum(c.columns * c.rows for c in image.components)
        image.blocks = out[lo:hi]
    return images


def _run_scan(out: np.ndarray, group: list, first: int, last: int, high: int, low: int, pattern: tuple[int, ...]) -> None:
    scans = [scan for _, (_, _, scan, _, _) in group]
    spans = [span for _, (_, _, _, span, _) in group]
    data = np.frombuffer(b"".join(raw[a:b] for (raw, _), (a, b) in zip(group, spans, strict=True)), np.uint8)
    first_byte = np.cumsum([0, *(b - a for a, b in spans)])
    plain = np.ones(len(data), bool)
    plain[1:] = ~((data[1:] == 0) & (data[:-1] == 0xFF))  # stuffed zeros go
    plain[first_byte[:-1][first_byte[:-1] < len(data)]] = True
    place = np.concatenate([[0], np.cumsum(plain)])
    segments = np.array([len(scan.starts) for scan in scans])
    shift = first_byte[:-1] - np.array([a for a, _ in spans])
    bits = _Bits(data[plain], place[np.concatenate([scan.starts for scan in scans]) + np.repeat(shift, segments)])
    order = np.concatenate([scan.order for scan in scans])
    interval = np.repeat([scan.interval for scan in scans], segments)
    mcus = np.repeat([len(scan.order) for scan in scans], segments)
    count = np.clip(mcus - ragged(np.zeros(len(scans), np.int64), segments) * interval, 0, interval)
    start = np.cumsum(count) - count
    used = group[0][1][1]
    if first == 0 and high:
        # One bit for each block in a row: no code to follow.
        run = count * len(pattern)
        position = bits.at[np.repeat(np.arange(len(run)), run)] + ragged(np.zeros(len(run), np.int64), run)
        byte = np.minimum(position >> 3, bits.most)
        bit = (bits.words[byte] >> (63 - (position & 7)).astype(np.uint64)) & np.uint64(1)
        out[order.ravel(), 0] |= bit.astype(np.int32) << low
        return
    blocks, slots = [], []
    for step in range(int(count.max()) if len(count) else 0):
        live = step < count
        for j, slot in enumerate(pattern):
            blocks.append(np.where(live, order[np.where(live, start + step, 0), j], -1))
            slots.append(slot)
    if first == 0 and not high:
        _dc_first(out, bits, blocks, [used[s] for s in slots], slots, low)
    else:
        _ac(out, bits, blocks, used[0], first, last, high, low)


def samples(image: Image, c: Component) -> np.ndarray:
    """A component's samples, 0 to 255, at its own resolution."""
    blocks = image.blocks[c.base - image.components[0].base :][: c.columns * c.rows]
    x = np.rint((blocks * image.quantisers[c.quantiser]).astype(np.float64) @ _WHOLE / SCALE + 128)
    plane = x.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8)
    return np.clip(plane, 0, 255)


def rgb(image: Image) -> np.ndarray:
    """The (height, width, 3) tensor, chroma repeated to full resolution."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = [np.repeat(np.repeat(samples(image, c), v // c.v, 0), h // c.h, 1)[: image.height, : image.width] for c in image.components]
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def stacked(images: list[Image]) -> Image:
    """One image of many of like width, components and quantisers, and of whole MCUs, below one another."""
    first = images[0]
    out = Image(first.width, sum(i.height for i in images), [Component(c.name, c.h, c.v, c.quantiser) for c in first.components], first.quantisers)
    out.frame(0)
    out.blocks = np.concatenate([i.blocks[c.base - i.components[0].base :][: c.columns * c.rows] for k in range(len(first.components)) for i in images for c in (i.components[k],)])
    return out
