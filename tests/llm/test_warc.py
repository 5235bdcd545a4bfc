import base64
import hashlib

import zstandard

from molecast.llm.warc import read_archives, read_one, record_index, seek_table, write_archives

PAGES = "page_id long, url string, html string"


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def cases():
    return [(i, f"http://e/{i} ü", f"<p>{i % 7} ü</p>" if i % 3 else f"<p>own {i}</p>" * (i + 1)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u\r\nX: y", "big\r\n\r\nWARC/1.1\r\n" * 40000), (103, "u", "tie"), (103, "u", "tie")]


def expected(rows, least=0):
    last = {}
    for i, _, h in rows:
        h = h or ""
        last[h] = max((x for x in (last.get(h), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and last[h or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [*cases(), (None, "u", "tie"), (None, None, "<p>1 ü</p>"), (None, "u", "only null ids have it"), (None, "u", "only null ids have it"), (7, "again", "another payload of an id"), (7, "again", None)]
    for least, limit in ((0, 250_000), (12, 0)):
        pages = frame(spark, rows).selectExpr("*", "1 AS payload", "'x' AS sha", "2 AS keeper", "true AS revisit", "3 AS again")
        got = read_archives(write_archives(pages, revisit_bytes=least, frame_bytes=2000, bundle_bytes=20000, broadcast_rows=limit))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == expected(rows, least)
        assert {bytes(r.payload).decode() for r in got.collect() if r.payload is not None} == {h or "" for _, _, h in rows}


def test_bundles_are_seekable_and_plain_zstandard(spark):
    archives = write_archives(frame(spark, cases()), frame_bytes=2000, bundle_bytes=20000)
    bundles = {r.bundle: bytes(r.data) for r in archives.collect()}
    assert len(bundles) > 1 and any(len(seek_table(b)) > 1 for b in bundles.values())
    for data in bundles.values():
        assert b"WARC/1.1" in zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    for r in record_index(archives).collect():
        head, _ = read_one(bundles[r.bundle], r.frame, r.offset)
        assert head["WARC-Record-ID"] == f"<urn:record:{r.page_id}>"


def test_empty_table(spark):
    assert read_archives(write_archives(frame(spark, []))).collect() == []
