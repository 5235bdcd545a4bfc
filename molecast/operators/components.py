"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Edges that a task contracts at a time.
CHUNK = 1 << 18
#: A node with more than this share of the edges is a hub; there are at most 1 / HUB of them, which bounds what is broadcast.
HUB = 1 / 1000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these edges reach from it), for nodes that aren't the least themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        was, low = label.copy(), np.minimum(label[u], label[v])
        for end in (label[u], label[v], u, v):
            np.minimum.at(label, end, low)
        label = label[label]
        if np.array_equal(was, label):
            break
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, CHUNK at a time, as stars around the least node of each connected part."""
    held, n = [], 0

    def stars() -> pa.RecordBatch:
        ends = least_reached(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def components(edges: DataFrame, rounds: int = 40, contracted: bool = False) -> DataFrame:
    """(node, label): each node of edges (a, b), of type long, with the smallest node that it reaches.

    Tasks first contract what edges they have, unless the edges come contracted (say, from a
    Python stage, which would then need a second worker in each task). Then large-star and small-star steps
    alternate until the edges no longer change. The minimum of a node's neighbours is a
    partially aggregated group; it is joined back by a broadcast for hubs, whose number
    is bounded by their share of the edges, and by a shuffle for the others, so that no
    task gets a hub's edges. Each round is written out; nothing but two counters comes
    to the driver.
    """

    def star(pairs: DataFrame, many: int) -> DataFrame:
        """Pairs (u, v) with the smallest of u and its neighbours v; many bounds the pairs."""
        least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        hub = F.col("n") > max(1, many * HUB)
        hubs = F.broadcast(least.filter(hub).select(F.col("u").alias("hub"), F.col("m").alias("low")))
        told = pairs.join(hubs, F.col("u") == F.col("hub"), "left")
        rest = least.filter(~hub).select(F.col("u").alias("own"), "m")
        plain = told.filter("low IS NULL").join(rest, F.col("u") == F.col("own")).select("u", "v", "m")
        return plain.unionByName(told.filter("low IS NOT NULL").select("u", "v", F.col("low").alias("m")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    stars = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a <> b")
    if not contracted:
        stars = stars.mapInArrow(_contract, "a long, b long")
    now = cut(stars.distinct(), "edges")
    was = state(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        large = cut(star(both, 2 * was[0]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b"), "edges")
        # Small-star: every smaller neighbour, and the node itself, is tied to the smallest.
        met = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), was[0])
        ends = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(met.select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
        if (is_ := state(now)) == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
