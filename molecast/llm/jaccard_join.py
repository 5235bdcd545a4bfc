"""N-gram Jaccard join through a count-vector R-tree.

Texts become sets of 64-bit hashes of word n-grams. The hashes fall into groups (by
their top bits); the counts of a set's hashes by group are a point, and the sum of
the coordinate minima of two points bounds the overlap of their sets from above. A
packed R-tree over the points joins node with node and point with point by this
bound, and the pairs that survive are verified by exact intersection.

Alone, such a tree can't scale: beyond a few coordinates all boxes overlap, and the
search reads every pair of like size. So the trees are built over small parts that
lose no link. (1) Prefix filter: in any order of hashes that all sets share, two
sets that link have a hash in common among the first n - ceil(t n) + 1 of each. The
order here is by rarity class, from a fixed-size count sketch over all documents,
then by hash, so that passages that many documents share come last. (2) Prefixes
are longer by l(n) = n / 10 hashes, and then two sets that link share at least
1 + l(0.8 n) of them. Of a set's prefix hashes, those stay that a set of like size
has too; a set with fewer of them than it must share is out, and of the others the
rarest few (counted exactly, up to MANY) suffice to share one with each partner.
(3) Sets that share such a hash and follow each other in size are tied, and the
connected parts of these ties are the candidate parts. (4) A large part is cut into blocks by size
class and hash, so that no task gets an unbounded part. First each block is searched,
and with the one that follows it: a group of near copies is connected by that, however
large, and its cost grows with its size. Only parts that aren't, are then searched by
all pairs of blocks whose sizes can link. In a tile, pairs that are already known to be
connected are skipped, so a group of near copies isn't expanded.

Exact copies of a set meet in one representative before anything is compared.

Defined cases: a null or empty text, or one without words, is an empty set and
links with nothing; a text with fewer words than n is one n-gram; rows with the
same id count as one document of each of their texts; a null id belongs to its
text's component and has no say in the component's smallest id (alone, its
component is null). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .common import cut, runs, small_side, spread_join, table

U = np.uint64
#: The count sketch has 2^SKETCH counters, sent in chunks of 2^CHUNK. Points have 2^GROUPS coordinates. A node of the tree has LEAF points.
SKETCH, CHUNK, GROUPS, LEAF = 20, 16, 6, 16
#: Hashes and sets of a block, about; sets of a block when all pairs of blocks are searched.
TILE_HASHES, TILE_SETS, PAIR_SETS = 250_000, 64, 512
#: Sets under one hash are counted up to this number, which stands for more.
MANY = 1000
#: Sets that a task remembers while it thins out ties.
FOREST = 100_000


class Words(dict):
    """Hash of each word, kept for the next time; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


@lru_cache
def _weight(i: int) -> np.uint64:
    """An odd multiplier for position i; unrelated ones, as sums of a progression's terms coincide."""
    return U(xxhash.xxh3_64_intdigest(i.to_bytes(8, "big")) | 1)


def shingles(text: str | None, words: Words, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, U)
    w = np.fromiter(map(words.__getitem__, parts), U, len(parts))
    k = min(n, len(parts))
    total = np.full(len(parts) - k + 1, U(k))
    for i in range(k):
        total += w[i : len(parts) - k + 1 + i] * _weight(i)
    return np.unique(_finish(total))


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def need(total: np.ndarray | int, percent: int):
    """The overlap from which two sets of these summed sizes link."""
    return -(-percent * total // (100 + percent))


def _first_pass(n: int):
    """(doc_id, mark, n, key) of each document, and at the end this task's part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, names = Words(), np.zeros(1 << SKETCH, np.uint32), ["doc_id", "mark", "n", "key", "chunk", "counts"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sets = [shingles(t, words, n) for t in part.column(1).to_pylist()]
                counts += np.bincount((np.concatenate(sets) >> U(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.uint32)
                none = [None] * len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        for i, chunk in enumerate(counts.reshape(-1, 1 << CHUNK)):
            if chunk.any():
                yield pa.RecordBatch.from_arrays([*(pa.array([None], pa.int64()) for _ in range(4)), pa.array([i], pa.int32()), pa.array([zlib.compress(chunk.astype(np.uint64).tobytes(), 1)])], names)

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk over a task's rows, as they come: at most 2^SKETCH counters are held."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint64)
            total[chunk] = total[chunk] + raw if chunk in total else raw
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["chunk", "counts"])


def _sketch(chunks: DataFrame, fan: int = 64) -> DataFrame:
    """The chunks added up, in two levels, so that no task gets those of all tasks."""
    some = chunks.withColumn("of", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition("chunk", "of").select("chunk", "counts").mapInArrow(_sum_chunks, "chunk int, counts binary")
    return some.repartition("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")


def rarity(chunks: list, total: int) -> np.ndarray:
    """Rarity class of each counter: 0 up to four times the mean load and 16, then by powers of two."""
    counts = np.zeros(1 << SKETCH)
    for row in chunks:
        counts[row["chunk"] << CHUNK : (row["chunk"] + 1) << CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    return np.maximum(0, np.ceil(np.log2(np.maximum(1, counts / (4 * total / (1 << SKETCH) + 16))))).astype(np.uint8)


def must_share(n, percent: int):
    """Prefix hashes that a set of size n has in common with each partner, at least."""
    return 1 + (percent * n + 99) // 100 // 10


def prefix(hashes: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 + n / 10 hashes in the order (rarity class, hash)."""
    n = len(hashes)
    order = np.argsort(classes[(hashes >> U(64 - SKETCH)).astype(np.int64)], kind="stable")
    return hashes[order[: n - (percent * n + 99) // 100 + 1 + n // 10]]


def _prefixes(classes, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, order = Words(), set(), classes.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                heads, keys, sizes = [np.empty(0, U)], [], []
                for text in batch.column(1).slice(lo, 2000).to_pylist():
                    hashes = shingles(text, words, n)
                    if len(hashes) and (key := set_key(hashes)) not in seen:  # copies within a task say it once
                        seen.add(key)
                        heads.append(prefix(hashes, order, percent))
                        keys.append(key), sizes.append(len(hashes))
                if len(seen) > 200_000:
                    seen.clear()
                each = [len(h) for h in heads[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["sig", "key", "n"])

    return run


def _shared(percent: int):
    """Rows (sig, key, n) sorted by sig, n and key: those with a set of like size under the same hash, and how many sets are under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(sig, key, size, big):
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            many = np.diff(np.append(start, len(sig)))
            m = np.where(np.repeat(sig[start] == big, many), MANY, np.minimum(np.repeat(many, many), MANY))
            like = (sig[1:] == sig[:-1]) & (100 * size[:-1].astype(np.int64) >= percent * size[1:].astype(np.int64))
            keep = np.concatenate([like, [False]]) | np.concatenate([[False], like]) | (m == MANY)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, key, size, m.astype(np.int32))], ["sig", "key", "n", "m"])

        held, big = [np.empty(0, k) for k in (np.int64, np.int64, np.int32)], None
        for batch in batches:
            rows = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])[: len(rows[0])]
            rows = [x[new] for x in rows]
            if not len(rows[0]):
                continue
            # The last run may go on in the next batch: it waits, unless it is long, or goes on from a long one.
            last = len(rows[0]) - int(np.argmax(np.append(rows[0][::-1] != rows[0][-1], True)))
            at, done = rows[0][-1], last
            if len(rows[0]) - last >= MANY or at == big:
                done = len(rows[0])
            if done:
                yield found(*(x[:done] for x in rows), big)
            held = [x[done:] for x in rows]
            if done > last:
                big = at
        if len(held[0]):
            yield found(*held, big)

    return run


def _ties(percent: int):
    """Rows sorted by hash, size and set: sets next to each other under one hash are tied if their sizes may link. Gives a spanning forest of this task's ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        last = None
        for batch in batches:
            sig, key, size = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                sig, key, size = (np.concatenate([x[None], y]) for x, y in zip(last, (sig, key, size), strict=True))
            if not len(sig):
                continue
            last = sig[-1], key[-1], size[-1]
            tied = (sig[1:] == sig[:-1]) & (key[1:] != key[:-1]) & (100 * size[:-1].astype(np.int64) >= percent * size[1:].astype(np.int64))
            out = []
            for a, b in np.unique(np.stack([key[:-1][tied], key[1:][tied]], 1), axis=0).tolist():
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((a, b))
            if len(parent) > FOREST:  # what comes later may repeat a tie, and loses none
                parent.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


class CountTree:
    """Packed R-tree over count vectors of sets sorted by size: nodes of LEAF points with their least size and largest coordinates."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets)
        self.points = np.bincount(owner * (1 << GROUPS) + (flat >> U(64 - GROUPS)).astype(np.int64), minlength=len(sets) << GROUPS).reshape(len(sets), -1).astype(np.int32)
        at = np.arange(0, len(sets), LEAF)
        self.boxes, self.least = np.maximum.reduceat(self.points, at), np.minimum.reduceat(self.sizes, at)
        _, self.ids = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flag = np.zeros(int(self.ids.max()) + 1, bool)

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact overlaps of set i with other sets."""
        own = self.ids[self.starts[i] : self.starts[i + 1]]
        self.flag[own] = True
        sizes = self.sizes[others]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[others] - first, sizes) + np.arange(int(sizes.sum()))
        out = np.add.reduceat(self.flag[self.ids[at]].astype(np.int64), first)
        self.flag[own] = False
        return out

    def links(self, percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the links; only between different sides, if given, and of different known components."""
        comp, out, n = np.arange(len(self.sizes)) if known is None else known.copy(), [], len(self.sizes)
        for node in range(len(self.least)):
            lo, hi = node * LEAF, min(n, (node + 1) * LEAF)
            most = self.sizes[hi - 1] * 100 // percent
            last = int(np.searchsorted(self.least, most, "right"))
            bound = np.minimum(self.boxes[node], self.boxes[node:last]).sum(1)
            near = node + np.flatnonzero(bound >= need(self.least[node] + self.least[node:last], percent))
            points = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
            points = points[points < n]
            for i in range(lo, hi):
                other = points[(points > i) & (comp[points] != comp[i]) & (100 * self.sizes[i] >= percent * self.sizes[points])]
                if side is not None:
                    other = other[side[other] != side[i]]
                if len(other):
                    least = need(self.sizes[i] + self.sizes[other], percent)
                    keep = np.minimum(self.points[i], self.points[other]).sum(1) >= least
                    other, least = other[keep], least[keep]
                if len(other):
                    for j in other[self.overlaps(i, other) >= least].tolist():
                        if comp[i] != comp[j]:
                            comp[comp == comp[j]] = comp[i]
                            out.append((i, j))
        return out


def _sets(n: int):
    """The hashes of each candidate's text, once for each tile; copies within a task say it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            if len(seen) > 200_000:
                seen.clear()
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for text, key, label, block, tiles in zip(*(batch.column(i).slice(lo, 200).to_pylist() for i in range(5)), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    data = shingles(text, words, n).tobytes()
                    rows += [(tile, key, label, block, len(data) // 8, data) for tile in tiles]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["tile", "key", "label", "block", "n", "data"])

    return run


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "tile"):
            key, label, block, size = (part.column(c).to_numpy() for c in ("key", "label", "block", "n"))
            order = np.lexsort((key, size))
            order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]  # a set that came twice
            data = part.column("data").to_pylist()
            tree = CountTree([np.frombuffer(data[i], U) for i in order])
            side = block[order] if len(np.unique(block[order])) > 1 else None
            known = np.unique(label[order], return_inverse=True)[1]
            if got := tree.links(percent, side, known):
                a, b = (key[order][list(x)] for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _with_blocks(parts: DataFrame, percent: int, sets: int, pairs: bool, broadcast_rows: int) -> DataFrame:
    """Adds block and tiles to (key, rep, n, part, label): the block is a large part's size class and a share of it. The tiles are the block itself, and with the next one; or with pairs, the block itself and with each other block that may link with it (blocks of another size, so that itself is needed again). A part that isn't large is one block and one tile."""
    wide = math.log(100 / percent) * 1.04 + 1e-9
    parts = parts.withColumn("cls", F.floor(F.log("n") / wide))
    # Sums by part and class are few, so that no task gets the rows of a large part.
    sums = cut(parts.groupBy("part", "cls").agg(F.sum("n").alias("hashes"), F.count("*").alias("sets")), "parts")
    whole = sums.groupBy("part").agg(F.sum("hashes").alias("h"), F.sum("sets").alias("s")).filter((F.col("h") > 2 * TILE_HASHES) | (F.col("s") > 2 * sets)).select("part")
    shares = sums.join(whole, "part").select("part", "cls", F.ceil(F.greatest(F.col("hashes") / TILE_HASHES, F.col("sets") / sets)).alias("own"))
    near = cut(shares.select("part", F.explode(F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)).alias("cls"), F.struct("cls", "own").alias("s")).groupBy("part", "cls").agg(F.collect_list("s").alias("shares")).select(F.col("part").alias("of_part"), F.col("cls").alias("of_cls"), "shares"), "shares")

    def blocks_of(cls: str) -> Column:
        """How many blocks a class of the part has; 0 if there is no such class."""
        return F.coalesce(F.expr(f"get(filter(shares, s -> s.cls = {cls}), 0).own"), F.lit(0))

    def block(cls: Column, at: Column) -> Column:
        return F.xxhash64("part", cls, at)

    met = spread_join(parts, near, [F.col("part") == F.col("of_part"), F.col("cls") == F.col("of_cls")], near.count(), broadcast_rows, "left")
    met = met.withColumn("at", F.pmod(F.xxhash64("key", F.lit(7)), F.greatest(blocks_of("cls"), F.lit(1)))).withColumn("own", F.when(F.col("shares").isNotNull(), block(F.col("cls"), F.col("at"))))
    if pairs:
        others = F.expr("flatten(transform(shares, s -> transform(sequence(0L, s.own - 1), j -> xxhash64(part, s.cls, j))))")
    else:
        after = F.when(F.col("at") + 1 < blocks_of("cls"), block(F.col("cls"), F.col("at") + 1)).when(blocks_of("cls + 1") > 0, block(F.col("cls") + 1, F.lit(0).cast("long")))
        before = F.when(F.col("at") > 0, block(F.col("cls"), F.col("at") - 1)).when(blocks_of("cls - 1") > 0, block(F.col("cls") - 1, blocks_of("cls - 1") - 1))
        others = F.filter(F.array("own", after, before), lambda o: o.isNotNull())
    tiles = F.transform(others, lambda o: F.xxhash64(F.least("own", o), F.greatest("own", o)))
    return met.select("key", "rep", "part", "label", F.col("own").isNotNull().alias("large"), F.coalesce("own", "part").alias("block"), F.when(F.col("own").isNull(), F.array("part")).otherwise(tiles).alias("tiles"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, mark, n, key), and the sets that have copies or links with an earlier row: of, first, the row (none, doc_id, mark) that comes first in the component.

    The mark is a hash of the text. With the id it names a row's text, also where ids are null or on several texts.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = plain.withColumn("mark", F.xxhash64("text"))
    first = cut(marked.mapInArrow(_first_pass(n), "doc_id long, mark long, n long, key long, chunk int, counts binary"), "sets")
    sets = first.filter("chunk IS NULL").select("doc_id", "mark", "n", "key")
    chunks = _sketch(first.filter("chunk IS NOT NULL").select("chunk", "counts")).collect()  # at most 2^20 counters
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = spark.sparkContext.broadcast(rarity(chunks, total))
    rows = plain.mapInArrow(_prefixes(classes, n, percent), "sig long, key long, n int")
    shared = rows.repartition("sig").sortWithinPartitions("sig", "n", "key").mapInArrow(_shared(percent), "sig long, key long, n int, m int")
    own = Window.partitionBy("key")
    least = F.floor(F.floor((F.col("n") * percent + 99) / 100) / 10)  # must_share - 1
    few = shared.withColumn("place", F.row_number().over(own.orderBy("m", "sig"))).withColumn("all", F.count("*").over(own)).filter(F.col("place") <= F.col("all") - least)
    ties = few.select("sig", "key", "n").repartition("sig").sortWithinPartitions("sig", "n", "key").mapInArrow(_ties(percent), "a long, b long")
    parts = cut(components(ties, contracted=True), "components")
    # Ids come before null.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    reps = sets.filter("key IS NOT NULL").groupBy("key").agg(F.min(row).alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"))
    candidates = cut(reps.join(small_side(parts, parts.count(), broadcast_rows), reps.key == parts.node).select("key", "rep", "n", "copies", F.col("label").alias("part")), "candidates")

    def links(blocks: DataFrame) -> DataFrame:
        """The links found in the tiles of these sets; the text is that of one row of each, by id and mark."""
        named = blocks.select(F.col("rep.doc_id").alias("of_id"), F.col("rep.mark").alias("of_mark"), "key", "label", "block", "tiles")
        texts = spread_join(marked, named, [F.col("mark") == F.col("of_mark"), F.col("doc_id").eqNullSafe(F.col("of_id"))], blocks.count(), broadcast_rows).select("text", "key", "label", "block", "tiles")
        tiles = texts.mapInArrow(_sets(n), "tile long, key long, label long, block long, n int, data binary")
        return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(percent), "a long, b long")

    blocks = cut(_with_blocks(candidates.withColumn("label", F.col("key")), percent, TILE_SETS, False, broadcast_rows), "blocks")
    found = cut(components(links(blocks), contracted=True), "components")
    # Large parts that aren't one component by now.
    large = blocks.filter("large").select("key", "part")
    told = large.join(small_side(found, found.count(), broadcast_rows), large.key == found.node, "left").select("part", F.coalesce("label", "key").alias("label"))
    open_ = cut(told.groupBy("part").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select(F.col("part").alias("of_part")), "open")
    if many := open_.count():
        left = spread_join(candidates, open_, [F.col("part") == F.col("of_part")], many, broadcast_rows).drop("of_part")
        left = left.join(small_side(found, found.count(), broadcast_rows), left.key == found.node, "left").select("key", "rep", "n", "part", F.coalesce("label", "key").alias("label"))
        more = links(cut(_with_blocks(left, percent, PAIR_SETS, True, broadcast_rows), "blocks"))
        found = cut(components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), contracted=True), "components")
    # The first row of each component of several sets, and the sets that aren't in it by themselves.
    linked = cut(candidates.join(small_side(found, found.count(), broadcast_rows), candidates.key == found.node).select("key", "rep", "label"), "linked")
    least = cut(linked.groupBy("label").agg(F.min("rep").alias("first")).withColumnRenamed("label", "of_label"), "first")
    later = spread_join(linked, least, [F.col("label") == F.col("of_label")], least.count(), broadcast_rows).select("key", "first")
    several = reps.filter("copies > 1").select(F.col("key").alias("copied"), "rep")
    of_key = several.join(later, F.col("key") == F.col("copied"), "full").select(F.coalesce("key", "copied").alias("of"), F.coalesce("first", "rep").alias("first"))
    return sets, cut(of_key, "of-key")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, broadcast_rows: int = 250_000) -> DataFrame:
    """doc_id, n_shingles, component_id: two texts link when 100 * overlap >= percent * union of their sets; a component is what links reach."""
    sets, of_key = _grouped(docs, id_col, text_col, n, percent, broadcast_rows)
    return spread_join(sets, of_key, [F.col("key") == F.col("of")], of_key.count(), broadcast_rows, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def near_copy_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, broadcast_rows: int = 250_000) -> DataFrame:
    """doc_id, mark, copies, stays: the rows of each component of several, by id and hash of the text, and how many rows are the same in both; the first of each component stays."""
    sets, of_key = _grouped(docs, id_col, text_col, n, percent, broadcast_rows)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    return spread_join(sets, of_key, [F.col("key") == F.col("of")], of_key.count(), broadcast_rows).select("doc_id", "mark", stays.alias("stays")).groupBy("doc_id", "mark", "stays").agg(F.count("*").alias("copies")).select("doc_id", "mark", "copies", "stays")


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies."""
    return jaccard_components(table(spark, sf_dir, "documents"))
