"""Media columns: MPEG audio streams.

``encode_stream`` carries a payload losslessly in MPEG-1 Layer III frames (its unit
is the byte of the frames' main data), behind an ID3v2 tag and an information
frame with frame count, byte count and seek table. ``read_stream`` parses any
stream of MPEG audio frames: it skips ID3v2 and ID3v1 tags, resynchronises on frame
headers (a candidate counts only if another header or the end follows where it
says, or if it is where a frame of its kind said), reads the variable-bitrate table
(of either kind, with its seek points), verifies the CRC of protected frames of all
layers, and gives the exact duration (samples over rate), the offset of each frame,
and the main data.

Defined cases: a null payload is empty; bytes that belong to no frame are counted
as skipped; a stream without frames has no frames and a duration of zero; a table or
tag that is cut off gives what of it is there, and any bytes can be read; frames of
free format (no bitrate said) aren't frames.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer), and Hz of MPEG-1; halves and quarters of those for MPEG-2 and 2.5.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
CRC_POLYNOMIAL = 0x8005
#: Bits of a subband's allocation in Layer II, as (bits, subbands) runs, by the allocation table's name.
ALLOCATION = {"2a": ((4, 11), (3, 12), (2, 4)), "2b": ((4, 11), (3, 12), (2, 7)), "2c": ((4, 2), (3, 6)), "2d": ((4, 2), (3, 10)), "half": ((4, 4), (3, 7), (2, 19))}
#: The frames that encode_stream writes: MPEG-1 Layer III, protected, 32 kHz, mono, 320 kbit/s (index 14), that is 1440 bytes.
HEADER = bytes((0xFF, 0xFA, 0xE8, 0xC0))
SIDE = 17
BODY = 1440 - 4 - 2 - SIDE


@dataclass(frozen=True)
class Header:
    """What the four bytes of a frame header say."""

    mpeg1: bool
    layer: int
    protected: bool
    kbits: int
    rate: int
    length: int
    samples: int
    side: int
    channels: int
    joint: int  # the subband from which a pair of channels shares its allocation


@lru_cache(4096)
def parse_header(four: bytes) -> Header | None:
    """None if these bytes can't start a frame."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    mpeg1, mono = version == 3, four[3] >> 6 == 3
    kbits, hertz, pad = BITRATES[mpeg1, layer][index], RATES[rate] // {3: 1, 2: 2, 0: 4}[version], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and not mpeg1 else 1152
    length = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples * 125 * kbits // hertz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if mpeg1 else (9 if mono else 17)
    joint = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(mpeg1, layer, not four[1] & 1, kbits, hertz, length, samples, side, 1 if mono else 2, joint)


@lru_cache(1 << 14)
def frame_crc(covered: bytes) -> int:
    """The CRC-16 over whole bytes."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (CRC_POLYNOMIAL if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def _crc_bits(crc: int, bits: str) -> int:
    for bit in bits:
        top = (crc >> 15) ^ (bit == "1")
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if top else 0)
    return crc


def _allocation(head: Header) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    each = head.kbits // head.channels
    if not head.mpeg1:
        name = "half"
    elif each < 56:
        name = "2d" if head.rate == 32000 else "2c"
    else:
        name = "2b" if each >= 96 and head.rate != 48000 else "2a"
    return [bits for bits, n in ALLOCATION[name] for _ in range(n)]


def checksum(data: bytes, at: int, head: Header) -> int:
    """The CRC that a protected frame should tell: over the last two header bytes and what decodes the samples (Layer III: side information; Layer II: allocation and scale factor selection; Layer I: allocation)."""
    if head.layer == 3:
        return frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side])
    body = data[at + 6 : at + 6 + 64]
    bits = f"{int.from_bytes(body):0{8 * len(body)}b}" if body else ""
    widths = [4] * 32 if head.layer == 1 else _allocation(head)
    end, chosen = 0, 0
    for band, w in enumerate(widths):
        for _ in range(head.channels if band < head.joint else 1):
            used = "1" in bits[end : end + w]
            chosen += used * (head.channels if band >= head.joint else 1)
            end += w
    if head.layer == 2:
        end += 2 * chosen
    return _crc_bits(frame_crc(data[at + 2 : at + 4]), bits[:end])


def _tag_size(data: bytes, at: int) -> int:
    """Bytes of an ID3v2 tag at this place, or 0."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return 0
    a, b, c, d = data[at + 6 : at + 10]
    return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 0x10 else 0)


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name + struct.pack(">I", len(body)) + b"\0\0" + body


def _frame(main: bytes) -> bytes:
    return HEADER + struct.pack(">H", frame_crc(HEADER[2:] + bytes(SIDE))) + bytes(SIDE) + main


def encode_stream(payload: bytes) -> bytes:
    """Tag, information frame, then the payload in frames; the tag gives the payload's length."""
    frames = -(-len(payload) // BODY)
    size = 1440 * (frames + 1)
    toc = bytes(min(255, 256 * i // 100) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, frames, size) + toc
    tag = _text_frame(b"TLEN", str(frames * 36)) + _text_frame(b"TXXX", f"payload\0{len(payload)}")
    n = len(tag)
    head = b"ID3\x04\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag
    padded = payload.ljust(frames * BODY, b"\0")
    return b"".join([head, _frame(info.ljust(BODY, b"\0")), *(_frame(padded[i : i + BODY]) for i in range(0, len(padded), BODY))])


@dataclass
class Stream:
    """What read_stream finds."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbits: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    told_frames: int | None = None
    told_bytes: int | None = None
    seek: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        main = b"".join(self.parts)
        told = self.tags.get("payload", "")
        return main[: int(told)] if told.isascii() and told.isdigit() and len(told) < 19 else main

    @property
    def duration(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


#: Text encodings of tags, by their first byte.
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _spread_size(four: bytes) -> int:
    """A number in the low seven bits of its bytes."""
    n = 0
    for byte in four:
        n = n << 7 | byte & 127
    return n


def _read_tags(tag: bytes, into: dict[str, str]) -> None:
    """The text frames of an ID3v2 tag: version 2.2 has names and sizes of three bytes, 2.4 has sizes of seven bits a byte."""
    version, flags, body = tag[3], tag[5], tag[10:]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2:
        body = body[_spread_size(body[:4]) if version > 3 else int.from_bytes(body[:4]) + 4 :]
    wide = 3 if version == 2 else 4
    head = 6 if version == 2 else 10
    p = 0
    while p + head <= len(body) and body[p]:
        name = body[p : p + wide].decode("latin-1")
        size = body[p + wide : p + 2 * wide]
        n = _spread_size(size) if version > 3 and not any(x & 0x80 for x in size) else int.from_bytes(size)
        content = body[p + head : p + head + n]
        if content and name[0] == "T":
            text = content[1:].decode(ENCODINGS.get(content[0], "latin-1"), "replace")
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            if name[:1].isalnum():
                into[name] = text.rstrip("\0")
        p += head + n


def _number(data: bytes, at: int, size: int) -> int | None:
    """A big-endian number, or None if the bytes end before."""
    piece = data[at : at + size]
    return int.from_bytes(piece) if len(piece) == size else None


def _table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Read a variable-bitrate table if this frame holds one. Seek points are byte offsets within the stream of frames."""
    frame = data[at : at + head.length]
    p = 4 + 2 * head.protected + head.side
    if frame[p : p + 4] in (b"Xing", b"Info"):
        flags, p = _number(frame, p + 4, 4) or 0, p + 8
        if flags & 1:
            out.told_frames, p = _number(frame, p, 4), p + 4
        if flags & 2:
            out.told_bytes, p = _number(frame, p, 4), p + 4
        if flags & 4 and out.told_bytes is not None:
            out.seek = [x * out.told_bytes // 256 for x in frame[p : p + 100]]
        return True
    if frame[36:40] == b"VBRI":
        out.told_bytes, out.told_frames = _number(frame, 46, 4), _number(frame, 50, 4)
        entries, scale, size = (_number(frame, i, 2) or 0 for i in (54, 56, 58))
        total = 0
        for i in range(entries if 0 < size <= 4 else 0):
            if (step := _number(frame, 62 + i * size, size)) is None:
                break
            total += step * scale
            out.seek.append(total)
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Parse a stream of MPEG audio."""
    out, at, end, first, sync = Stream(), 0, len(data), True, None
    if data[-128:-125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    while at < end:
        if size := _tag_size(data, at):
            _read_tags(data[at : min(at + size, end)], out.tags)
            at += size
            continue
        head = parse_header(data[at : at + 4])
        stop = at + head.length if head else end + 1
        known = head and stop <= end and (stop == end or parse_header(data[stop : stop + 4]) or _tag_size(data, stop) or sync == (at, head.mpeg1, head.layer, head.rate))
        if not known:
            after = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end)
            to = min((x for x in (after, tag) if x >= 0), default=end)
            out.skipped += to - at
            at = to
            continue
        if head.protected:
            out.bad_checksums += checksum(data, at, head) != _number(data, at + 4, 2)
        if not (first and _table(data, at, head, out)):
            out.offsets.append(at)
            out.samples += head.samples
            out.rate, out.kbits = head.rate, max(out.kbits, head.kbits)
            out.parts.append(data[at + 4 + 2 * head.protected + head.side : stop])
        first, at, sync = False, stop, (stop, head.mpeg1, head.layer, head.rate)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length, and the bytes padded with 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sizes, media = zip(*((n, encode_stream(p)) for n, p in map(padded, part.column(1).to_pylist())), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the padded text of each row as an MPEG audio stream."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames long, samples long, rate int, duration_s double, offsets array<long>, bad_checksums long, skipped_bytes long, told_frames long, table_agrees boolean, seek array<long>, tags map<string, string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in READ.replace("map<string, string>", "map").split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = []
            for doc, n, media in zip(*(batch.slice(lo, 512).column(i).to_pylist() for i in range(3)), strict=True):
                s = read_stream(media)
                rows.append((doc, n, s.payload, len(media), hashlib.sha256(media).hexdigest(), len(s.offsets), s.samples, s.rate, s.duration, s.offsets, s.bad_checksums, s.skipped, s.told_frames, None if s.told_frames is None else s.told_frames == len(s.offsets), s.seek, list(s.tags.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_media(media: DataFrame) -> DataFrame:
    """Parse a media column (doc_id, n_bytes, media): payload, exact duration, frame offsets, checksums, tags, and whether the table tells as many frames as there are."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio and read back."""
    read = read_media(encode_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(";", F.format_string("frames=%d", "n_frames"), F.format_string("samples=%d", "samples"), F.format_string("rate=%d", "rate"), F.format_string("bad_crc=%d", "bad_checksums"), F.format_string("last_offset=%d", F.try_element_at("offsets", F.lit(-1)))).alias("feature"),
        "duration_s", "offsets", "table_agrees",
    )
