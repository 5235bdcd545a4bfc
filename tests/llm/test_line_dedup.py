import random
from collections import defaultdict

import numpy as np
import pytest

from molecast.llm.line_dedup import OP1_SQL, PerfectHash, Shard, dedup_lines, digests, line_keys, op1_line_dedup

from .helpers import docs

LONG = "x" * 30


def brute(rows, min_docs=3, min_chars=20):
    holders = defaultdict(set)
    for i, t in rows:
        for key in {k for k in line_keys((t or "").encode()) if len(k.decode()) >= min_chars}:
            holders[key].add(-(1 << 63) if i is None else i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(line_keys(x.encode())[0], me := -(1 << 63) if i is None else i) == me]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    pool = [f"A common line number {i} " + "é" * (i % 5) for i in range(12)] + ["short", "ÄÖÜ" * 6, "ÄÖÜ" * 7, " \t" + LONG.upper() + "\r"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {j} with some more text" for j in range(rng.randrange(1, 12)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (None, LONG), (102, LONG), (103, LONG + "\n" + LONG), (103, LONG), (104, "\n\n"), (105, "word " * 20000), (106, "a\rb\x0b" + LONG), (107, twice := "held by one document twice, " + LONG), (107, twice), (108, twice), (None, "null ids are one document " + LONG), (None, "null ids are one document " + LONG), (None, "null ids are one document " + LONG)]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_equals_brute_force(spark, limit):
    rows = cases()
    got = dedup_lines(docs(spark, rows, [("kept", "clash"), ("n_lines", 1)]), broadcast_bytes=limit).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_empty_table_and_nothing_common(spark, limit):
    assert dedup_lines(docs(spark, []), broadcast_bytes=limit).collect() == []
    assert [r.n_dropped for r in dedup_lines(docs(spark, [(1, LONG), (2, LONG)]), broadcast_bytes=limit).collect()] == [0, 0]


def test_perfect_hash_is_minimal_and_shards_round_trip():
    a, b = digests([b"key %d" % i for i in range(5000)])
    h = PerfectHash.build(a, b)
    assert sorted(h.slots(a, b)) == list(range(5000))
    shard = Shard.from_bytes(Shard.build(a, b, np.arange(5000) + 1, np.arange(5000) * 7).to_bytes())
    counts, keepers = shard.lookup(a, b)
    assert (counts == np.arange(5000) + 1).all() and (keepers == np.arange(5000) * 7).all()
    other = digests([b"other %d" % i for i in range(5000)])
    assert not shard.lookup(*other)[0].any()


def test_equals_the_sql_with_repeated_and_null_ids(spark, tmp_path):
    import duckdb

    rows = [(i, t.replace("\r", " ") if t else t) for i, t in cases()]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(((r[0], r[1], r[2], r[3]) for r in duckdb.sql(OP1_SQL).fetchall()), key=repr)
    assert sorted((tuple(r) for r in op1_line_dedup(spark, str(tmp_path)).collect()), key=repr) == want
