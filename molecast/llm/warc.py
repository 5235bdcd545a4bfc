"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, the frames of a bundle are
followed by a skippable frame with the seek table (the public seekable format),
and an index maps each record identifier to its bundle, frame and offset within
the decompressed frame. A record never straddles two frames. Bundles are rows of a
binary column that Spark writes to the shared folder, so that its committer, and
not the task, decides what survives a lost executor.

Payloads that occur more than once are stored once: of the records with equal
payloads of at least ``revisit_bytes`` bytes the one with the largest identifier is
the response, and the others are revisit records that name it.

Defined cases: a null payload is empty; a null url is written as an empty target;
a null identifier sorts below all others; rows that repeat the response's
identifier and payload are responses too. An empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, table

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
URN = "urn:record:"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, and gives its length in a header of its own."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    block = HTTP if revisit else HTTP + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a decompressed frame."""
    at = 0
    while at < len(frame):
        stop = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        body = stop + 4
        end = body + int(head["Content-Length"])
        if frame[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed")
        yield at, head, frame[body:end]
        at = end + 4


class BundleWriter:
    """Collects records into frames of about frame_bytes, and frames into one bundle."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level).compress, frame_bytes
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame of the record, and its offset there."""
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.open)
        self.open += record
        return len(self.frames), at

    def flush(self) -> None:
        if self.open:
            raw = bytes(self.open)
            packed = self.pack(raw)
            self.frames.append(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(packed)
            self.open = bytearray()

    def close(self) -> bytes:
        self.flush()
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, size, checksum) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    width, at, out = 12 if flags & 0x80 else 8, 0, []
    rows = bundle[-9 - n * width : -9]
    for i in range(n):
        packed, size, *check = struct.unpack_from("<III" if width == 12 else "<II", rows, i * width)
        out.append((at, packed, size, check[0] if check else -1))
        at += packed
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int, int]) -> bytes:
    start, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=max(size, 1))
    if len(raw) != size or check not in (-1, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF):
        raise ValueError("a frame doesn't match the seek table")
    return raw


def read_one(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: the record at the offset of a frame; other frames are not touched."""
    raw = read_frame(bundle, seek_table(bundle)[frame])
    return next((h, b) for at, h, b in read_records(raw) if at == offset)


def _write(frame_bytes: int, bundle_bytes: int):
    """Rows (page_id, url, payload, sha, refers_to, revisit) to rows (bundle, data, index)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, index = BundleWriter(frame_bytes), []

        def done() -> pa.RecordBatch:
            data = writer.close()
            name = hashlib.sha1(data).hexdigest()
            rows = pa.array([[{"page_id": p, "frame": f, "offset": o, "length": n} for p, f, o, n in index]], pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), rows], ["bundle", "data", "index"])

        for batch in batches:
            for page, url, payload, sha, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = write_record(page, url, (payload or "").encode(), base64.b32encode(sha).decode(), refers, revisit)
                index.append((page, *writer.add(record), len(record)))
                if writer.size + len(writer.open) >= bundle_bytes:
                    yield done()
                    writer, index = BundleWriter(frame_bytes), []
        if index:
            yield done()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20, broadcast_rows: int = 250_000) -> DataFrame:
    """Write a record for each row; returns the table of bundles: bundle, data, index (page_id, frame, offset, length). Payloads are shuffled only if there are more revisits than may be broadcast."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    keys = cut(rows.filter(F.octet_length("payload") >= revisit_bytes).select("page_id", "sha"), "digests")
    shared = cut(keys.groupBy(F.col("sha").alias("of_sha")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("of_sha", "keeper"), "shared")
    # Only identifiers are joined by digest; a digest that very many rows have is dealt over tasks.
    again = spread_join(keys, shared, [F.col("sha") == F.col("of_sha")], shared.count(), broadcast_rows).filter(~F.col("page_id").eqNullSafe(F.col("keeper")))
    again = cut(again.select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "keeper").distinct(), "revisits")
    met = spread_join(rows, again, [F.col("page_id").eqNullSafe(F.col("again")), F.col("sha") == F.col("again_sha")], again.count(), broadcast_rows, "left")
    out = met.select("page_id", "url", "payload", "sha", "keeper", F.col("again_sha").isNotNull())
    return cut(out.toDF("page_id", "url", "payload", "sha", "refers_to", "revisit").mapInArrow(_write(frame_bytes, bundle_bytes), "bundle string, data binary, index array<struct<page_id: long, frame: int, offset: long, length: long>>"), "warc")


def record_index(archives: DataFrame) -> DataFrame:
    """page_id to bundle, frame, offset within the decompressed frame, and length."""
    return archives.select("bundle", F.explode("index").alias("i")).select("i.page_id", "bundle", "i.frame", "i.offset", "i.length")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def key(uri: str) -> int | None:
        got = re.fullmatch(rf"<{URN}(-?\d+|None)>", uri)[1]
        return None if got == "None" else int(got)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for bundle in batch.column(0):
            data = bundle.as_py()
            for entry in seek_table(data):
                rows = []
                for _, head, block in read_records(read_frame(data, entry)):
                    revisit = head["WARC-Type"] == "revisit"
                    payload, said = block[block.index(b"\r\n\r\n") + 4 :], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest32(payload) != said:
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't match its digest")
                    rows.append((key(head["WARC-Record-ID"]), head["WARC-Target-URI"], None if revisit else payload, int(head["X-Payload-Length"]) if revisit else len(payload), said, head["WARC-Type"], key(head["WARC-Refers-To"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the bundles, frame by frame; response payloads are held against their digests."""
    return archives.select("data").mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC bundles and read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
b AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b
"""
