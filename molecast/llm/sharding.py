"""Sharding by a k-d tree over metadata.

The tree starts with all rows and splits each node at the weighted median of its
widest dimension (range within the node over range of the table) until the leaves
hold about the target bytes; leaves are the shards, and the law is ``bytes``.

Medians are exact up to a tolerance and distributed: the rows of all nodes of a
level are counted by digits of an order-preserving key (dimension, then text hash),
one digit a round; executors find the bin that holds the median of each node, and
only that is refined. What comes to the driver is one row a node. Rows with equal texts have
equal keys, so a cut goes between texts; only a text whose copies weigh more than
``whole`` of a leaf is itself cut, by a hash of the identifier.

Slots number the rows of a shard without gaps: rows are dealt into buckets by hash,
buckets get offsets from their counts, and numbering is within a bucket, so that no
task sorts a whole shard.

Defined cases: a null text has no bytes, size 1 and a null checksum; repeated rows
get slots of their own; an empty table gives an empty result; columns other than
those asked for are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, literal_table, table

#: Bits of a digit; of the key; and of these, of the dimension.
DIGIT, KEY_BITS, DIM_BITS = 8, 56, 28


@dataclass
class Node:
    """A node of the tree: its weight, the shards below it, and the search for its cut."""

    weight: float
    shards: int
    first: int
    dim: int = 0
    low: int = 0
    below: float = 0.0
    key: str = "k1"
    at1: int | None = None
    at2: int | None = None
    left: float = 0.0

    @property
    def goal(self) -> float:
        return self.weight * (self.shards // 2) / self.shards


def text_dims(text: str) -> list[Column]:
    """Metadata of a text: bytes, lines, and bytes for each character."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.log2(F.octet_length(body) + 1.0), F.log2(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1.0), F.octet_length(body) / F.greatest(F.length(body), F.lit(1))]


def _find_cuts(rows: DataFrame, nodes: dict[int, Node], tolerance: float, whole: float) -> None:
    """Set at1 (and at2) of each node: rows with k1 < at1, or k1 = at1 and k2 < at2, go left."""
    spark, open_, shift = rows.sparkSession, dict(nodes), KEY_BITS - DIGIT
    while open_:
        find = literal_table(spark, [(i, n.low, n.key == "k2", n.at1 or 0, n.goal - n.below) for i, n in open_.items()], "node int, low long, second boolean, at1 long, goal double")
        key = F.when(F.col("second"), F.col("k2")).otherwise(F.col("k1"))
        met = rows.join(F.broadcast(find), "node").filter(~F.col("second") | (F.col("k1") == F.col("at1")))
        bins = met.withColumn("bin", F.shiftright(key - F.col("low"), shift)).filter((F.col("bin") >= 0) & (F.col("bin") < 1 << DIGIT)).groupBy("node", "goal", "bin").agg(F.sum("weight").alias("w"))
        # A node has at most 2^DIGIT bins. The one in which its goal falls is the first that reaches it, else the last.
        of = Window.partitionBy("node")
        sums = bins.withColumn("to", F.sum("w").over(of.orderBy("bin"))).withColumn("last", F.max("bin").over(of))
        cuts = sums.filter((F.col("to") >= F.col("goal")) | (F.col("bin") == F.col("last"))).groupBy("node").agg(F.min(F.struct("bin", "w", (F.col("to") - F.col("w")).alias("before"))).alias("x"))
        found = {r["node"]: r["x"] for r in cuts.collect()}
        for i, n in list(open_.items()):
            if i not in found:  # a node without rows
                n.at1, n.at2 = 0, -1
                del open_[i]
                continue
            digit, w, below = int(found[i]["bin"]), float(found[i]["w"]), n.below + float(found[i]["before"])
            low, last = n.low + (digit << shift), shift == 0
            n.low, n.below = low, below
            if w <= tolerance * n.weight or last and (n.key == "k2" or w <= whole * n.weight / n.shards):
                up = n.goal - below > below + w - n.goal
                edge, n.left = (low + (1 << shift), below + w) if up else (low, below)
                if n.key == "k1":
                    n.at1, n.at2 = edge, -1
                else:
                    n.at2 = edge
                del open_[i]
            elif last:
                n.at1, n.key, n.low = low, "k2", 0
        shift = shift - DIGIT if shift else KEY_BITS - DIGIT


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: list[Column] | None = None, tolerance: float = 0.001, whole: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; give the number of shards, or the bytes that a shard should hold."""
    spark, parts = docs.sparkSession, dims or text_dims(text_col)
    named = [p.cast("double").alias(f"d{i}") for i, p in enumerate(parts)]
    text, ident = F.col(text_col), F.col(id_col)
    rows = cut(docs.select(ident.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(1 << (KEY_BITS - DIM_BITS))).alias("text_hash"), F.shiftrightunsigned(F.xxhash64(ident.cast("string"), F.lit(3)), 64 - KEY_BITS).alias("k2"), *named), "shard-rows")
    rows = rows.withColumn("weight", F.col("size"))
    names = [f"d{i}" for i in range(len(parts))]
    span = rows.agg(F.sum("weight").alias("w"), *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max))).first()
    total = span["w"] or 0
    shards = shards or max(1, -(-total // target_bytes))
    base = {c: (span[f"min_{c}"] or 0.0, max((span[f"max_{c}"] or 0.0) - (span[f"min_{c}"] or 0.0), 1e-300)) for c in names}
    scaled = F.array(*(F.coalesce(((F.col(c) - F.lit(base[c][0])) / F.lit(base[c][1]) * (2**DIM_BITS - 1)).cast("long"), F.lit(0)) for c in names))
    now = rows.select("doc_id", "size", "text_crc32", "text_hash", "k2", "weight", scaled.alias("at"), F.lit(0).alias("node"))
    nodes, leaves, level = {0: Node(float(total), shards if total else 1, 0)}, {}, 0
    while True:
        leaves |= {i: n.first for i, n in nodes.items() if n.shards == 1}
        nodes = {i: n for i, n in nodes.items() if n.shards > 1}
        if not nodes:
            break
        ranges = now.groupBy("node").agg(*(f(F.col("at")[i]).alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.min, F.max))).collect()
        for r in ranges:
            if r["node"] in nodes:
                nodes[r["node"]].dim = max(range(len(names)), key=lambda i: (r[f"max{i}"] - r[f"min{i}"], -i))  # noqa: B023
        dim = literal_table(spark, [(i, n.dim) for i, n in nodes.items()], "node int, dim int")
        k1 = F.expr(f"shiftleft(get(at, coalesce(dim, 0)), {KEY_BITS - DIM_BITS}) + text_hash")
        keyed = cut(now.join(F.broadcast(dim), "node", "left").withColumn("k1", k1).drop("dim"), f"level{level}")
        _find_cuts(keyed, nodes, tolerance, whole)
        splits = literal_table(spark, [(i, n.at1, n.at2) for i, n in nodes.items()], "node int, at1 long, at2 long")
        right = (F.col("k1") > F.col("at1")) | (F.col("k1") == F.col("at1")) & (F.col("k2") >= F.col("at2"))
        now = keyed.join(F.broadcast(splits), "node", "left").withColumn("node", F.when(F.col("at1").isNull(), F.col("node")).otherwise(F.col("node") * 2 + 1 + right.cast("int"))).drop("at1", "at2", "k1")
        below = {}
        for i, n in nodes.items():
            half = n.shards // 2
            below |= {2 * i + 1: Node(n.left, half, n.first), 2 * i + 2: Node(n.weight - n.left, n.shards - half, n.first + half)}
        nodes, level = below, level + 1
    leaf = literal_table(spark, list(leaves.items()), "node int, shard int")
    placed = cut(now.join(F.broadcast(leaf), "node").select("doc_id", "size", "text_crc32", "shard"), "placed")
    return with_slots(placed)


def with_slots(placed: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """Adds slot: the rows of each shard are numbered from 0 without gaps."""
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, -(-most // bucket_rows)))))
    sums = placed.groupBy("shard", "bucket").count()
    before = sums.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).drop("count")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("number", number).join(before, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("number") - 1).cast("long")).drop("bucket", "before", "number")


def op3_sharding(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = kd_shards(table(spark, sf_dir, "documents") if docs is None else docs, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
