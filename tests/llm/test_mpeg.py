import hashlib
import os
import random
import zlib

from molecast.llm.mpeg import BODY, HEADER, encode_media, encode_stream, frame_crc, padded, parse_header, read_media, read_stream

from .helpers import docs


def test_round_trip_of_payloads():
    for n in (0, 1, 64, BODY - 1, BODY, BODY + 1, 10 * BODY):
        payload = os.urandom(n)
        s = read_stream(encode_stream(payload))
        assert s.payload == payload and not s.bad_checksums and not s.skipped
        assert len(s.offsets) == -(-n // BODY) == s.told_frames and s.duration == len(s.offsets) * 1152 / 32000


def test_resynchronises_after_junk_and_finds_damage():
    data = encode_stream(b"abc" * 2000)
    s = read_stream(data)
    junk = b"\xff\xfb\x00junk\xff" * 9
    at = s.offsets[2]
    t = read_stream(data[:at] + junk + data[at:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert t.payload == s.payload and t.skipped == len(junk) and t.tags["ID3v1"] == "title"
    assert t.offsets == [o if o < at else o + len(junk) for o in s.offsets]
    broken = bytearray(data)
    broken[s.offsets[1] + 7] ^= 1  # side information, which the checksum covers
    assert read_stream(bytes(broken)).bad_checksums == 1
    assert read_stream(b"no audio at all").offsets == [] and read_stream(b"").duration == 0


def test_headers():
    h = parse_header(HEADER)
    assert (h.mpeg1, h.layer, h.protected, h.kbits, h.rate, h.length, h.samples, h.side) == (True, 3, True, 320, 32000, 1440, 1152, 17)
    assert parse_header(bytes((0xFF, 0xFB, 0x90, 0x00))).length == 417  # 128 kbit/s at 44.1 kHz
    assert parse_header(bytes((0xFF, 0xFB, 0xF0, 0x00))) is None and parse_header(b"\xff\xe0") is None
    assert 0 <= frame_crc(b"\0" * 19) < 1 << 16


def test_columns(spark):
    rows = [(1, "text ü"), (2, None), (3, ""), (4, "x" * 100000), (5, "text ü"), (5, "text ü"), (None, "a\0b")]
    got = read_media(encode_media(docs(spark, rows, [("media", "clash"), ("payload", 1)]))).collect()
    want = sorted(((i, *padded(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.payload)) for r in got), key=repr) == want
    assert len({r.media_sha256 for r in got if r.n_bytes == 7}) == 1
    assert all(len(r.payload) % 64 == 0 and len(r.payload) for r in got)
    assert read_media(encode_media(docs(spark, []))).collect() == []


def test_query_digests(spark, tmp_path):
    from molecast.llm.mpeg import op6_media_columns

    docs(spark, [(1, "abc" * 50), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_media_columns(spark, str(tmp_path)).collect()}
    _, p = padded("abc" * 50)
    assert got[1].payload_sha256 == hashlib.sha256(p).hexdigest() and got[1].tail_crc32 == zlib.crc32(p[-64:])
    assert got[2].payload_bytes == 64 and got[2].n_bytes == 0


def crc_by_division(bits: str) -> int:
    """The remainder of polynomial division, with a register of ones put before: not the way of the library."""
    value = int(bits + "0" * 16, 2) ^ (0xFFFF << len(bits))
    for i in range(len(bits) + 15, 15, -1):
        if value >> i & 1:
            value ^= 0x18005 << (i - 16)
    return value & 0xFFFF


def protected(header: bytes, body: bytes, covered_bits: int) -> bytes:
    """A frame with a right checksum over the header's last bytes and so many bits of the body."""
    bits = f"{int.from_bytes(header[2:]):016b}" + f"{int.from_bytes(body):0{8 * len(body)}b}"[:covered_bits]
    return header + crc_by_division(bits).to_bytes(2) + body


def test_checksums_of_layers_one_and_two():
    # (header, subbands' bits with two channels up to the joint one, allocation of the first subband's bits and what it chooses)
    cases = [
        (bytes((0xFF, 0xFE, 0x80, 0x00)), 32 * 4 * 2, 0),  # Layer I, stereo
        (bytes((0xFF, 0xFE, 0x80, 0xC0)), 32 * 4, 0),  # Layer I, mono
        (bytes((0xFF, 0xFE, 0x80, 0x50)), 8 * 8 + 24 * 4, 0),  # Layer I, joint from subband 8
        (bytes((0xFF, 0xFC, 0x80, 0xC0)), 11 * 4 + 12 * 3 + 7 * 2, 2),  # Layer II, mono, 128 kbit/s at 44.1 kHz: 30 subbands, one with selection
        (bytes((0xFF, 0xFC, 0x18, 0xC0)), 2 * 4 + 10 * 3, 2),  # Layer II, mono, 32 kbit/s at 32 kHz: 12 subbands
        (bytes((0xFF, 0xF4, 0x80, 0xC0)), 4 * 4 + 7 * 3 + 19 * 2, 2),  # MPEG-2 Layer II, mono
    ]
    for header, allocation, selection in cases:
        head = parse_header(header)
        body = bytearray(head.length - 6)
        body[0] = 0x10 if selection else 0
        frame = protected(header, bytes(body), allocation + selection)
        s = read_stream(frame * 3)
        assert len(s.offsets) == 3 and not s.bad_checksums, header.hex()
        body[(allocation + selection - 1) // 8] ^= 1 << (7 - (allocation + selection - 1) % 8) if not selection else 0
        if not selection:
            damaged = frame[:6] + bytes(body)
            assert read_stream(frame + damaged + frame).bad_checksums == 1


def test_tables_and_tags_of_all_kinds():
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0")
    vbri = bytearray(frame)
    vbri[36:70] = b"VBRI" + bytes(6) + (417 * 3).to_bytes(4) + (3).to_bytes(4) + (3).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + b"".join((417).to_bytes(2) for _ in range(3)) + b"\0\0"
    s = read_stream(bytes(vbri) + frame * 3)
    assert (s.told_frames, s.told_bytes, s.seek, len(s.offsets)) == (3, 1251, [417, 834, 1251], 3)
    old = b"TT2" + (6).to_bytes(3) + b"\0title" + b"TXX" + (6).to_bytes(3) + b"\0k\0val"
    assert read_stream(b"ID3\x02\0\0" + bytes((0, 0, 0, len(old))) + old + frame * 2).tags == {"TT2": "title", "k": "val"}
    wide = b"TIT2" + (9).to_bytes(4) + b"\0\0\x01" + "abc".encode("utf-16")
    assert read_stream(b"ID3\x03\0\0" + bytes((0, 0, 0, len(wide))) + wide + frame * 2).tags == {"TIT2": "abc"}


def test_any_bytes_can_be_read():
    rng = random.Random(5)
    short = bytes((0xFF, 0xF3, 0x14, 0xC4)).ljust(22, b"\0") + b"Xing"  # a frame that ends with its table's name
    tag = b"TXXX" + len(text := "\x03payload\x00300²".encode()).to_bytes(4) + b"\0\0" + text
    odd = [short, short * 3, b"ID3\x04\0\0" + bytes((0, 0, 0, len(tag))) + tag + short * 2, b"ID3", b"TAG", b"\xff"]
    whole = encode_stream(b"some payload " * 300)
    for k in range(400):
        data = bytearray(rng.choice([whole, *odd, bytes(rng.choice(b"\xff\xfb\xf3\xe0ID3XingVBRI\0\x90") for _ in range(rng.randrange(300)))]))
        for _ in range(rng.randrange(6) if data else 0):
            at = rng.randrange(len(data))
            if rng.random() < 0.5:
                data[at] = rng.randrange(256)
            else:
                del data[at : at + rng.randrange(1, 40)]
            if not data:
                break
        s = read_stream(bytes(data))
        assert s.skipped <= len(data) and all(0 <= o < len(data) for o in s.offsets) and s.payload is not None and s.duration >= 0
    assert read_stream(odd[2]).payload is not None
