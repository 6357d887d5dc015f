"""Signatures, frame headers and containers: MPEG audio, ADTS, ISO base media, Ogg."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checksums import crc32_ogg
from .errors import incomplete, invalid

#: Brands of MP4 audio files, and bytes of an Ogg stream in which its codec must show; fixed values.
BRANDS = (b"M4A ", b"M4B ", b"mp41", b"mp42", b"isom", b"iso2", b"iso4", b"iso5", b"iso6", b"dash")
OGG_HEAD = 1 << 16


def sniff(data: Column) -> Column:
    """wav, flac, opus, vorbis, aac or mp3 by the first bytes of a binary column, else null.

    Native: nothing but the head of each file is looked at.
    """
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")
    at = lambda i, text: F.substring(data, i + 1, len(text)) == F.lit(text)
    head = F.hex(F.substring(data, 1, OGG_HEAD))
    # A match of hex digits counts only at a whole byte.
    holds = lambda text: head.rlike("^(?:..)*?" + text.hex().upper())
    size = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long")
    end = F.when(size == 0, F.octet_length(data)).otherwise(F.least(size, F.octet_length(data).cast("long")))
    places = F.when(end >= 12, F.sequence(F.lit(8).cast("long"), end - 4, F.lit(4).cast("long"))).otherwise(F.array().cast("array<long>"))
    brand = F.exists(places, lambda o: (o != 12) & F.substring(data, 1, 1 << 30).substr((o + 1).cast("int"), F.lit(4)).isin(*(bytearray(b) for b in BRANDS)))
    sync = (F.octet_length(data) >= 2) & (byte(0) == 255)
    return (
        F.when(at(0, b"RIFF") & at(8, b"WAVE"), "wav")
        .when(at(0, b"fLaC"), "flac")
        .when(at(0, b"OggS"), F.when(holds(b"OpusHead"), "opus").when(holds(b"vorbis"), "vorbis"))
        .when(at(4, b"ftyp") & brand, "aac")
        .when(sync & (byte(1).bitwiseAND(0xF6) == 0xF0), "aac")
        .when(at(0, b"ID3") | sync & (byte(1).bitwiseAND(0xE0) == 0xE0), "mp3")
    )


# --- MPEG audio ----------------------------------------------------------------

#: Bit rates in kbit/s by (version 1 or not, layer) and sampling rates by version; fixed values of the format.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES[False, 3] = BITRATES[False, 2]
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass
class MpegHeader:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: bool
    mode: int  # 0 stereo, 1 joint stereo, 2 dual, 3 mono
    mode_extension: int
    notes: int = 0  # copyright, original and emphasis

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return (72 if self.layer == 3 and self.version != 3 else 144) * self.kbps * 1000 // self.rate + self.padding

    def to_bytes(self) -> bytes:
        kbps = BITRATES[self.version == 3, self.layer].index(self.kbps)
        rate = MPEG_RATES[self.version].index(self.rate)
        return bytes([0xFF, 0xE0 | self.version << 3 | (4 - self.layer) << 1 | (not self.crc), kbps << 4 | rate << 2 | self.padding << 1, self.mode << 6 | self.mode_extension << 4 | self.notes])


def mpeg_header(raw: bytes) -> MpegHeader:
    if len(raw) < 4:
        raise incomplete("MPEG header")
    if raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        raise invalid("MPEG sync")
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    kbps, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or kbps in (0, 15) or rate == 3:
        raise invalid("MPEG header")
    return MpegHeader(version, layer, not raw[1] & 1, BITRATES[version == 3, layer][kbps], MPEG_RATES[version][rate], bool(raw[2] >> 1 & 1), raw[3] >> 6, raw[3] >> 4 & 3, raw[3] & 15)


def mpeg_frames(raw: bytes) -> list[tuple[int, MpegHeader]]:
    """Offsets and headers of frames that follow one another."""
    at, out = 0, []
    while at < len(raw):
        head = mpeg_header(raw[at : at + 4])
        if at + head.length > len(raw):
            raise incomplete("MPEG frame")
        out.append((at, head))
        at += head.length
    return out


# --- ADTS ----------------------------------------------------------------------

#: Sampling rates by index; fixed values of the format.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


@dataclass
class AdtsFrame:
    profile: int
    rate: int
    channels: int
    payload: bytes
    length: int


def adts_frame(payload: bytes, rate: int, channels: int, profile: int = 1) -> bytes:
    length = 7 + len(payload)
    if length > 8191 or rate not in AAC_RATES or not 1 <= channels <= 7:
        raise invalid("ADTS frame")
    return bytes([0xFF, 0xF1, profile << 6 | AAC_RATES.index(rate) << 2 | channels >> 2, (channels & 3) << 6 | length >> 11, length >> 3 & 0xFF, (length & 7) << 5 | 0x1F, 0xFC]) + payload


def adts_frames(raw: bytes) -> list[AdtsFrame]:
    at, out = 0, []
    while at < len(raw):
        head = raw[at : at + 7]
        if len(head) < 7:
            raise incomplete("ADTS header")
        if head[0] != 0xFF or head[1] & 0xF0 != 0xF0:
            raise invalid("ADTS sync")
        length, size = (head[3] & 3) << 11 | head[4] << 3 | head[5] >> 5, 7 if head[1] & 1 else 9
        index = head[2] >> 2 & 15
        if length < size or index >= len(AAC_RATES):
            raise invalid("ADTS header")
        if at + length > len(raw):
            raise incomplete("ADTS frame")
        out.append(AdtsFrame(head[2] >> 6, AAC_RATES[index], (head[2] & 1) << 2 | head[3] >> 6, raw[at + size : at + length], length))
        at += length
    return out


# --- ISO base media ------------------------------------------------------------

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta"}


def boxes(raw: bytes, start: int = 0, end: int | None = None, path: str = "", depth: int = 0):
    """(path, depth, offset, size) of every box, at most 16 deep; a broken size ends its level."""
    end, at = len(raw) if end is None else end, start
    while at + 8 <= end and depth <= 16:
        size, name = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if size < 8 or at + size > end:
            return
        here = f"{path}/{name.decode('latin1')}"
        yield here, depth, at, size
        if name in CONTAINERS:
            yield from boxes(raw, at + 8, at + size, here, depth + 1)
        at += size


def _box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + name + body


def _u32(*values: int) -> bytes:
    return b"".join(v.to_bytes(4, "big") for v in values)


def _descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag, len(body)]) + body


def mux_m4a(adts: bytes) -> bytes:
    """An .m4a file of the frames of an ADTS stream of one format."""
    frames = adts_frames(adts)
    if not frames or len({(f.profile, f.rate, f.channels) for f in frames}) > 1:
        raise invalid("no frames, or frames of several formats")
    f, n = frames[0], len(frames)
    config = ((f.profile + 1) << 11 | AAC_RATES.index(f.rate) << 7 | f.channels << 3).to_bytes(2, "big")
    esds = _descriptor(3, b"\0\1\0" + _descriptor(4, bytes([0x40, 0x15]) + bytes(3) + _u32(0, 0) + _descriptor(5, config)) + _descriptor(6, b"\2"))
    entry = _box(b"mp4a", bytes(6) + b"\0\1" + bytes(8), f.channels.to_bytes(2, "big") + b"\0\x10" + bytes(4), _u32((f.rate & 0xFFFF) << 16), _box(b"esds", _u32(0), esds))
    duration = n * 1024
    matrix = _u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(offset: int) -> bytes:
        tables = [
            _box(b"stsd", _u32(0, 1), entry), _box(b"stts", _u32(0, 1, n, 1024)), _box(b"stsc", _u32(0, 1, 1, n, 1)),
            _box(b"stsz", _u32(0, 0, n, *(len(x.payload) for x in frames))), _box(b"stco", _u32(0, 1, offset)),
        ]
        dinf = _box(b"dinf", _box(b"dref", _u32(0, 1), _box(b"url ", _u32(1))))
        minf = _box(b"minf", _box(b"smhd", _u32(0, 0)), dinf, _box(b"stbl", *tables))
        mdia = _box(b"mdia", _box(b"mdhd", _u32(0, 0, 0, f.rate, duration), b"\x55\xc4\0\0"), _box(b"hdlr", _u32(0, 0) + b"soun" + bytes(13)), minf)
        tkhd = _box(b"tkhd", _u32(7, 0, 0, 1, 0, duration), bytes(8) + b"\0\0\0\0\1\0\0\0" + matrix, _u32(0, 0))
        mvhd = _box(b"mvhd", _u32(0, 0, 0, f.rate, duration, 0x10000) + b"\1\0" + bytes(10) + matrix + bytes(24) + _u32(2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = _box(b"ftyp", b"M4A " + _u32(0) + b"M4A mp42isom")
    start = len(head) + len(moov(0)) + 8
    return head + moov(start) + _box(b"mdat", *(x.payload for x in frames))


def demux_m4a(raw: bytes) -> bytes:
    """The ADTS stream of an .m4a file whose samples fill its mdat box."""
    found = {path.rsplit("/", 1)[1]: (at, size) for path, _, at, size in boxes(raw)}
    if not {"mdat", "stsz", "stsd"} <= found.keys():
        raise invalid("a box is missing")
    at, size = found["stsd"]
    place = raw.find(b"esds", at, at + size)
    if place < 0:
        raise invalid("no esds box")
    config_at = raw.find(b"\x05", place + 8 + 3 + 5)
    config = int.from_bytes(raw[config_at + 2 : config_at + 4], "big")
    at, size = found["stsz"]
    same, n = (int.from_bytes(raw[at + 12 + k : at + 16 + k], "big") for k in (0, 4))
    if not same and n > (size - 20) // 4:
        raise invalid("sample table")
    sizes = [same] * n if same else [int.from_bytes(raw[at + 20 + 4 * i : at + 24 + 4 * i], "big") for i in range(n)]
    at, size = found["mdat"]
    if sum(sizes) != size - 8:
        raise invalid("samples don't fill the data box")
    index, out, at = config >> 7 & 15, [], at + 8
    if index >= len(AAC_RATES):
        raise invalid("sampling rate")
    for n in sizes:
        out.append(adts_frame(raw[at : at + n], AAC_RATES[index], config >> 3 & 15, (config >> 11) - 1))
        at += n
    return b"".join(out)


# --- Ogg -----------------------------------------------------------------------


@dataclass
class OggPage:
    flags: int  # 1 continued, 2 first, 4 last
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes

    def to_bytes(self) -> bytes:
        def page(crc: int) -> bytes:
            return b"OggS\0" + bytes([self.flags]) + (self.granule & (1 << 64) - 1).to_bytes(8, "little") + self.serial.to_bytes(4, "little") + self.sequence.to_bytes(4, "little") + crc.to_bytes(4, "little") + bytes([len(self.lacing)]) + self.lacing + self.body

        return page(crc32_ogg(page(0)))


def ogg_pages(raw: bytes, check: bool = False) -> list[OggPage]:
    at, out = 0, []
    while at < len(raw):
        if at + 27 > len(raw):
            raise incomplete("Ogg page header")
        if raw[at : at + 4] != b"OggS" or raw[at + 4]:
            raise invalid("Ogg page")
        n = raw[at + 26]
        lacing = raw[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if len(lacing) < n or at + size > len(raw):
            raise incomplete("Ogg page")
        whole = raw[at : at + size]
        if check and crc32_ogg(whole[:22] + bytes(4) + whole[26:]) != int.from_bytes(whole[22:26], "little"):
            raise invalid("Ogg checksum")
        out.append(OggPage(whole[5], int.from_bytes(whole[6:14], "little", signed=True), int.from_bytes(whole[14:18], "little"), int.from_bytes(whole[18:22], "little"), lacing, whole[27 + n :]))
        at += size
    return out


def ogg_packets(pages: list[OggPage]) -> list[tuple[bytes, int]]:
    """Packets put together across pages, each with its page's granule position."""
    out, part = [], None
    for page in pages:
        if bool(page.flags & 1) != (part is not None):
            raise invalid("Ogg continuation")
        at = 0
        for size in page.lacing:
            part = (part or b"") + page.body[at : at + size]
            at += size
            if size < 255:
                out.append((part, page.granule))
                part = None
    if part is not None:
        raise incomplete("Ogg packet")
    return out


def mux_ogg(packets: list[tuple[bytes, int]], serial: int) -> bytes:
    """One packet to a page (several pages for a long one); the last page ends the stream."""
    pages = []
    for k, (packet, granule) in enumerate(packets):
        lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        for start in range(0, len(lacing), 255):
            part = lacing[start : start + 255]
            ends = part[-1] < 255
            flags = (start > 0) | 2 * (k == 0 and start == 0) | 4 * (k == len(packets) - 1 and start + 255 >= len(lacing))
            pages.append(OggPage(int(flags), granule if ends else -1, serial, len(pages), part, packet[start * 255 : start * 255 + sum(part)]))
    return b"".join(p.to_bytes() for p in pages)


def opus_toc(first: int) -> dict[str, int]:
    """Configuration, stereo flag, frame count code and samples of a frame at 48 kHz."""
    config = first >> 3
    if config < 12:
        samples = (480, 960, 1920, 2880)[config & 3]
    elif config < 16:
        samples = (480, 960)[config & 1]
    else:
        samples = 120 << (config & 3)
    return {"config": config, "stereo": first >> 2 & 1, "count_code": first & 3, "frame_samples": samples}


def opus_head(channels: int, pre_skip: int, rate: int) -> bytes:
    return b"OpusHead\1" + bytes([channels]) + pre_skip.to_bytes(2, "little") + rate.to_bytes(4, "little") + b"\0\0\0"


def opus_span(packets: list[tuple[bytes, int]]) -> tuple[int, int]:
    """Samples to skip at the start, and valid samples: the largest granule position less those."""
    head = packets[0][0] if packets else b""
    if head[:8] != b"OpusHead" or len(head) < 19:
        raise invalid("OpusHead")
    skip = int.from_bytes(head[10:12], "little")
    return skip, max(0, max((g for _, g in packets[2:]), default=0) - skip)
