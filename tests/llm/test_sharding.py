import random
import zlib
from collections import Counter, defaultdict

from molecast.llm.sharding import kd_shards, with_slots

from .helpers import docs, words


def test_shards_are_near_equal_gapless_and_keep_texts_together(spark):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(1500)]
    rows = [(i, texts[rng.randrange(800)] if i % 4 == 0 else texts[i]) for i in range(1500)]
    got = kd_shards(docs(spark, rows, [("shard", 9), ("slot", 1), ("node", 2), ("weight", 1.5)]), shards=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500))
    sizes, slots, of = Counter(), defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[text[r.doc_id]].add(r.shard)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) / min(sizes.values()) < 1.06
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in of.values()) <= 4  # of about 85 texts to a shard


def test_a_hot_text_is_split(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i} " * 3) for i in range(900)]
    sizes = Counter()
    for r in kd_shards(docs(spark, rows), shards=8).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) / min(sizes.values()) < 1.25


def test_defined_cases(spark):
    assert kd_shards(docs(spark, []), shards=16).collect() == []
    odd = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (4, "é\n" * 50000)]
    got = kd_shards(docs(spark, odd), shards=4).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted([("1", 1), ("2", 1), ("3", 2), ("3", 2), ("None", 2), ("4", 150001)])
    assert {r.text_crc32 for r in got if r.doc_id == 1} == {None}
    one = kd_shards(docs(spark, [(1, "abc")]), target_bytes=100).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_fewer_rows_than_shards(spark):
    for n in (1, 2, 3, 5):
        got = kd_shards(docs(spark, [(i, "word " * (i + 1)) for i in range(n)]), shards=16).collect()
        assert sorted(r.doc_id for r in got) == list(range(n)) and all(0 <= r.shard < 16 for r in got)
        assert len({(r.shard, r.slot) for r in got}) == n


def test_slots_over_many_buckets(spark):
    placed = spark.range(1000).selectExpr("id AS doc_id", "id AS size", "id AS text_crc32", "CAST(id % 2 AS INT) AS shard")
    got = with_slots(placed, bucket_rows=50).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(500))


def test_equals_a_plain_tree(spark):
    """One node's cut is the weighted median of the widest dimension, found by sorting."""
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 400)))) for i in range(600)]
    got = {r.doc_id: r for r in kd_shards(docs(spark, rows), shards=2, tolerance=0.0).collect()}
    sizes = {i: len(t.encode()) + 1 for i, t in rows}
    # Texts have one line and no wide letters, so bytes is the only dimension with a range.
    below, total = 0, sum(sizes.values())
    order = sorted(sizes, key=lambda i: sizes[i])
    for i in order:
        if below + sizes[i] > total / 2:
            middle = sizes[i]
            break
        below += sizes[i]
    assert all(got[i].shard == 0 for i in order if sizes[i] < middle) and all(got[i].shard == 1 for i in order if sizes[i] > middle)
    left = sum(sizes[i] for i in order if got[i].shard == 0)
    assert abs(left - total / 2) <= max(sizes.values())
