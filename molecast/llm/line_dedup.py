"""Line dedup through a sharded minimal perfect hash.

The distinct line keys that occur in enough documents are hashed to 128 bits and
dealt into shards. Each shard holds a minimal perfect hash (a cascade of
collision-free bit levels with ranks) that maps a key to a slot of three compact
arrays: a 64-bit fingerprint, the document count, and the document that keeps the
line. Documents probe these arrays; lines are never joined with lines.

An index within ``broadcast_bytes`` is sent to every task. A larger one stays
sharded: probes (document, line hash) are routed to the shards, salted so that a
very common line is spread over tasks, and stream past the shard's arrays.

Defined cases: a null or empty text is one empty line. Documents are counted by
their distinct ids: rows that share an id are one document, and keep or lose a line
together; a null id is one id, below all others. There is a row of the result for
each row of the input. Counts beyond 2^32 - 1 stand at that number. Lines are split
at \\n only. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, cut, spread_join, table

U = np.uint64
SALTS = 8


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(SPACE) for line in raw.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as two arrays of uint64."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * U(0x9E3779B97F4A7C15)) ^ U(((level + 1) * 0xD1342543DE82EF95) & (2**64 - 1))
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class PerfectHash:
    """Minimal perfect hash over distinct (a, b) pairs: level i keeps the keys that alone hit a bit of it, the rest go on."""

    def __init__(self, bits: list[np.ndarray], sizes: list[int]):
        self.bits, self.sizes, self.ranks, before = bits, sizes, [], 0
        for packed in bits:
            ones = np.bitwise_count(packed).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        self.n = before

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        bits, sizes, level = [], [], 0
        while len(a):
            size = max(64, -(-2 * len(a) // 64) * 64)
            at = (_mix(a, b, level) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(U))
            sizes.append(size)
            rest = ~alone[at]
            a, b, level = a[rest], b[rest], level + 1
        return cls(bits, sizes)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key outside the set, -1 or any slot (the fingerprint tells)."""
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (packed, size) in enumerate(zip(self.bits, self.sizes, strict=True)):
            if not len(open_):
                break
            at = (_mix(a[open_], b[open_], level) % U(size)).astype(np.int64)
            word, bit = packed[at >> 6], U(1) << (at & 63).astype(U)
            hit = (word & bit) != 0
            below = np.bitwise_count(word & (bit - U(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[level][at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


class Shard:
    """One shard: the perfect hash, and by slot fingerprint, count and keeper."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.perfect, self.prints, self.counts, self.keepers = perfect, prints, counts, keepers

    @classmethod
    def build(cls, a, b, counts, keepers) -> Shard:
        perfect = PerfectHash.build(a, b)
        order = np.empty(len(a), np.int64)
        order[perfect.slots(a, b)] = np.arange(len(a))
        return cls(perfect, b[order], np.minimum(counts[order], 2**32 - 1).astype(np.uint32), keepers[order])

    def to_bytes(self) -> bytes:
        head = np.array([len(self.perfect.sizes), len(self.prints), *self.perfect.sizes], np.int64)
        return b"".join(x.tobytes() for x in (head, *self.perfect.bits, self.prints, self.keepers, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        levels, n = np.frombuffer(data, np.int64, 2)
        sizes, at, bits = np.frombuffer(data, np.int64, levels, 16).tolist(), 16 + 8 * int(levels), []
        for size in sizes:
            bits.append(np.frombuffer(data, U, size // 64, at))
            at += size // 8
        return cls(PerfectHash(bits, sizes), np.frombuffer(data, U, n, at), np.frombuffer(data, np.uint32, n, at + 16 * n), np.frombuffer(data, np.int64, n, at + 8 * n))

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if absent) and keeper of each key."""
        slot = self.perfect.slots(a, b)
        found = (slot >= 0) & (len(self.prints) > 0)
        found[found] = self.prints[slot[found]] == b[found]
        counts, keepers = np.zeros(len(a), np.int64), np.full(len(a), NULL_ID, np.int64)
        counts[found], keepers[found] = self.counts[slot[found]], self.keepers[slot[found]]
        return counts, keepers


def _ids(batch: pa.RecordBatch) -> list[int]:
    return [NULL_ID if x is None else x for x in batch.column(0).to_pylist()]


def _doc_keys(raw: bytes, least: int) -> list[bytes]:
    """Distinct keys of a document that are long enough."""
    return [k for k in dict.fromkeys(line_keys(raw)) if long_enough(k, least)]


def _hash_lines(least: int):
    """(a, b, doc): the hashes of each document's long keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, ids, a, b = _flat(batch, least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int64), ids)], ["a", "b", "doc"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, shard_keys: int = 1 << 17) -> DataFrame:
    """(shard, bits, data): the shards of the index over the line keys found in at least min_docs documents, about shard_keys keys each."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_hash_lines(min_chars), "a long, b long, doc long")
    # The planner first makes (line, document) distinct, dealt by both, so that a very common line is spread over tasks.
    common = cut(lines.groupBy("a", "b").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= min_docs), "lines")
    bits = max(0, (-(-common.count() // shard_keys) - 1).bit_length())

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[c].to_numpy(np.int64).view(U) for c in "ab")
        return pd.DataFrame({"shard": [key[0]], "data": [Shard.build(a, b, rows["n"].to_numpy(), rows["keeper"].to_numpy(np.int64)).to_bytes()]})

    shard = F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0).cast("long")
    return cut(common.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard long, data binary").withColumn("bits", F.lit(bits)), "line-index")


OUT = "doc_id long, kept string, n_lines long, n_dropped long"


def _emit(batch: pa.RecordBatch, drops: list[set[bytes]]) -> pa.RecordBatch:
    """Cut the lines with dropped keys from the texts of a batch."""
    kept, lines, dropped = [], [], []
    for text, drop in zip(batch.column(1).to_pylist(), drops, strict=True):
        text = text or ""
        if not drop:
            n = text.count("\n") + 1
            kept.append(text), lines.append(n), dropped.append(0)
            continue
        raw = text.encode()
        parts = raw.split(b"\n")
        stay = [p for p, k in zip(parts, line_keys(raw), strict=True) if k not in drop]
        kept.append(b"\n".join(stay).decode()), lines.append(len(parts)), dropped.append(len(parts) - len(stay))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])


def _flat(batch: pa.RecordBatch, least: int):
    """All distinct long keys of a batch's documents: the keys, their document's number and id, their hashes."""
    ids, keys, owner = _ids(batch), [], []
    for i, text in enumerate(batch.column(1).to_pylist()):
        own = _doc_keys((text or "").encode(), least)
        keys += own
        owner += [i] * len(own)
    owner = np.array(owner, np.int64)
    return keys, owner, np.array(ids, np.int64)[owner], *digests(keys)


def _probe_all(index, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard.from_bytes(v) for k, v in index.value}
        for batch in batches:
            keys, owner, ids, a, b = _flat(batch, least)
            drops: list[set[bytes]] = [set() for _ in range(batch.num_rows)]
            at = (a >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
            for k in np.unique(at):
                if int(k) in shards:
                    mine = np.flatnonzero(at == k)
                    counts, keepers = shards[int(k)].lookup(a[mine], b[mine])
                    for j in mine[(counts > 0) & (keepers != ids[mine])]:
                        drops[owner[j]].add(keys[j])
            yield _emit(batch, drops)

    return run


def _route(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner, ids, a, b = _flat(batch, least)
            marks = batch.column(2).to_numpy()[owner]
            at = (a >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, marks % SALTS, ids, marks, a.view(np.int64), b.view(np.int64))], ["shard", "salt", "doc", "mark", "a", "b"])

    return run


def _probe_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and salt, the shard's arrays before its probes. Gives the probes whose line goes."""
    at, shard = None, None
    for batch in batches:
        places = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if (here := tuple(places[:, lo])) != at:
                at, shard = here, None
            if part.column(2)[0].is_valid:
                shard, part = Shard.from_bytes(part.column(2)[0].as_py()), part.slice(1)
            if shard is None or not part.num_rows:
                continue
            ids, marks, a, b = (part.column(i).to_numpy() for i in (3, 4, 5, 6))
            counts, keepers = shard.lookup(a.view(U), b.view(U))
            go = (counts > 0) & (keepers != ids)
            yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (ids, marks, a, b)], ["doc", "mark", "a", "b"])


def _apply_hits(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = {(h["a"], h["b"]) for h in hits or ()}
                keys = _doc_keys((text or "").encode(), least) if gone else []
                a, b = digests(keys)
                drops.append({k for k, *h in zip(keys, a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True) if tuple(h) in gone})
            yield _emit(batch, drops)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Drop each line whose key (of at least min_chars code points) at least min_docs documents hold, except from the largest id holding it.

    Returns doc_id, kept (the text that stays), n_lines, n_dropped: one row for each input row.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, min_docs, min_chars)
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("b"), F.coalesce(F.max("bits"), F.lit(0)).alias("bits")).first()
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if size["b"] <= broadcast_bytes:
        held = spark.sparkContext.broadcast([(r["shard"], bytes(r["data"])) for r in index.select("shard", "data").collect()])
        return plain.mapInArrow(_probe_all(held, size["bits"], min_chars), OUT)
    # A row is named by its id and the hash of its text, also where ids are null or on several texts.
    marked = plain.withColumn("mark", F.xxhash64("text"))
    probes = marked.mapInArrow(_route(size["bits"], min_chars), "shard long, salt long, doc long, mark long, a long, b long").withColumn("data", F.lit(None).cast("binary"))
    none = F.lit(None).cast("long")
    shards = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "data", none.alias("doc"), none.alias("mark"), none.alias("a"), none.alias("b"))
    met = shards.unionByName(probes).select("shard", "salt", "data", "doc", "mark", "a", "b").repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
    hits = cut(met.mapInArrow(_probe_shard, "doc long, mark long, a long, b long").groupBy("doc", F.col("mark").alias("of")).agg(F.collect_set(F.struct("a", "b")).alias("hits")), "line-hits")
    joined = spread_join(marked, hits, [F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("doc"), F.col("mark") == F.col("of")], hits.count(), 10_000, "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(_apply_hits(min_chars), OUT)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines dropped, and the SHA-256 of the text that stays."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, text FROM documents),
lines AS (
  SELECT r, doc_id, id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM (SELECT r, doc_id, id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT r, doc_id, id, string_split(coalesce(text, ''), chr(10)) AS parts FROM docs))),
common AS (
  SELECT key, max(id) AS keeper FROM (SELECT DISTINCT id, key FROM lines WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND c.keeper <> l.id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.key IS NULL OR c.keeper = l.id), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON c.key = l.key GROUP BY l.r
"""
