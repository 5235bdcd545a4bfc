"""Spatial joins: range joins and k-nearest-neighbour joins over points (id, x, y, z).

Space is cut into cubes of the cutoff's size, one side is
copied to the cubes around it, and cubes meet in an equi-join, with the inclusive
distance predicate on what meets. A plain distance predicate would be planned as a
nested loop over all pairs. An index is a table of points bucketed by cube.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut

AROUND = tuple(product((-1, 0, 1), repeat=3))
#: Half of the cubes around one, so that each pair of neighbouring cubes meets once.
AHEAD = tuple(o for o in AROUND if o > (0, 0, 0))


def cells(df: DataFrame, cutoff: float, offsets=None) -> DataFrame:
    """Adds c0, c1, c2, the cube of each point; with offsets, a copy for each cube that far from it."""
    own = [F.floor(F.col(c) / F.lit(cutoff)) for c in ("x", "y", "z")]
    if offsets is None:
        return df.select("*", *(c.alias(f"c{i}") for i, c in enumerate(own)))
    steps = F.array(*(F.struct(*(F.lit(v).alias(f"o{i}") for i, v in enumerate(o))) for o in offsets))
    return df.select("*", F.explode(steps).alias("o")).select(*df.columns, *((c + F.col(f"o.o{i}")).alias(f"c{i}") for i, c in enumerate(own)))


def _named(df: DataFrame, ident: str, mark: str) -> DataFrame:
    return df.select(F.col(ident).alias(f"{mark}id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))


def _distance(a: str, b: str):
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def distance_join(query: DataFrame, points: DataFrame, cutoff: float, query_id: str = "id", point_id: str = "id", copy: str = "query") -> DataFrame:
    """q, p, d2 of all pairs with d2 <= cutoff^2. ``copy`` names the smaller side, which is copied to 27 cubes."""
    if cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    q, p = _named(query, query_id, "q"), _named(points, point_id, "p")
    q, p = cells(q, cutoff, AROUND if copy == "query" else None).alias("q"), cells(p, cutoff, AROUND if copy != "query" else None).alias("p")
    met = q.join(p, [F.col(f"q.c{i}") == F.col(f"p.c{i}") for i in range(3)])
    return met.select(F.col("qid").alias("q"), F.col("pid").alias("p"), _distance("q", "p").alias("d2")).filter(F.col("d2") <= cutoff * cutoff)


def self_join(points: DataFrame, cutoff: float, point_id: str = "id") -> DataFrame:
    """a < b, d2: each unordered pair within the cutoff once. A point meets its own cube and the half of the 26 around that lies ahead."""
    if cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    base = _named(points, point_id, "p")
    a = cells(base.withColumn("own", F.lit(True)), cutoff, ((0, 0, 0),)).unionByName(cells(base.withColumn("own", F.lit(False)), cutoff, AHEAD)).alias("a")
    b = cells(base, cutoff).alias("b")
    met = a.join(b, [F.col(f"a.c{i}") == F.col(f"b.c{i}") for i in range(3)]).filter(~F.col("a.own") | (F.col("a.pid") < F.col("b.pid")))
    return met.select(F.least("a.pid", "b.pid").alias("a"), F.greatest("a.pid", "b.pid").alias("b"), _distance("a", "b").alias("d2")).filter(F.col("d2") <= cutoff * cutoff)


def neighbour_lists(query: DataFrame, points: DataFrame, cutoff: float, query_id: str = "id", point_id: str = "id") -> DataFrame:
    """q and its sorted neighbours; queries without any keep an empty list."""
    lists = distance_join(query, points, cutoff, query_id, point_id).groupBy("q").agg(F.array_sort(F.collect_list("p")).alias("found"))
    return query.select(F.col(query_id).alias("q")).join(lists, "q", "left").select("q", F.coalesce("found", F.array().cast(lists.schema["found"].dataType)).alias("neighbours"))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy("d2", "p"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def _levels(df: DataFrame, sizes: list[float], around: bool = False, level: bool = False) -> DataFrame:
    """Adds level, c0, c1, c2: the cube of each point for each size, or of its own level; with around, also the cubes next to it."""
    chosen = F.array(*map(F.lit, sizes))
    df = df if level else df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))))
    own = [F.floor(F.col(c) / F.get(chosen, F.col("level"))) for c in "xyz"]
    if not around:
        return df.select(*df.columns, *(c.alias(f"c{i}") for i, c in enumerate(own)))
    steps = F.array(*(F.struct(*(F.lit(v).alias(f"o{i}") for i, v in enumerate(o))) for o in AROUND))
    return df.select(*df.columns, F.explode(steps).alias("o")).select(*df.columns, *((c + F.col(f"o.o{i}")).alias(f"c{i}") for i, c in enumerate(own)))


def knn_join(query: DataFrame, points: DataFrame, k: int, cutoff: float | None = None, query_id: str = "id", point_id: str = "id") -> DataFrame:
    """q, p, d2, place: the k nearest points of each query, within the cutoff if given; ties go to the smaller id.

    Each query looks at cubes of a size of its own: the smallest, of halves of the whole
    extent or of the cutoff (beyond which nobody looks), whose cube around the query holds so many points that k
    should be within the size. One pass answers most queries, also where some regions
    are much denser than others; those with fewer than k points within their size go on
    with twice the size. Of points at the same place only the k smallest ids matter, so
    that a crowded place isn't joined with itself.
    """
    if k <= 0:
        return distance_join(query, points, cutoff or 1.0, query_id, point_id).withColumn("place", F.lit(1)).limit(0)
    if cutoff is not None and cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    spans = [f(c) for part in (points, query) for c in "xyz" for f in (F.min, F.max)]
    box = points.agg(F.count("*").alias("n"), *(s.alias(f"b{i}") for i, s in enumerate(spans[:6]))).crossJoin(query.agg(*(s.alias(f"q{i}") for i, s in enumerate(spans[6:])))).first()  # one row each
    if not box["n"] or box["q0"] is None:
        return _nearest(distance_join(query, points, cutoff or 1.0, query_id, point_id), k)
    low = [min(box[f"b{2 * i}"], box[f"q{2 * i}"]) for i in range(3)]
    high = [max(box[f"b{2 * i + 1}"], box[f"q{2 * i + 1}"]) for i in range(3)]
    whole = max(sum((h - lo) ** 2 for lo, h in zip(low, high, strict=True)) ** 0.5, 1e-9) * (1 + 1e-9)
    # Evenly spread points would need this many halves; some more are for denser regions.
    halves = 5 + max(0, math.ceil(math.log2(max(1.0, box["n"] / k)) / 3))
    top = whole if cutoff is None else min(whole, cutoff)
    sizes = [top / 2**j for j in range(max(1, halves - math.floor(math.log2(whole / top))))]
    place = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("pid"))
    p = _named(points, point_id, "p").withColumn("place", place).filter(F.col("place") <= k).drop("place")
    q = _named(query, query_id, "q")
    held = _levels(p, sizes)
    counts = held.groupBy("level", "c0", "c1", "c2").agg(F.count("*").alias("n"))
    # A ball of a cube's size around a query has about four times the cube's volume.
    dense = _levels(q, sizes).join(counts, ["level", "c0", "c1", "c2"]).filter(F.col("n") >= max(1.0, k / 2))
    level = dense.groupBy(F.col("qid").alias("of")).agg(F.max("level").alias("level"))
    left = cut(q.join(level, F.col("qid").eqNullSafe(F.col("of")), "left").select("qid", "x", "y", "z", F.coalesce("level", F.lit(0)).alias("level")), "queries")
    limit = F.get(F.array(*(F.lit(s * s) for s in sizes)), F.col("a.level"))
    out = None
    while True:
        a, b = _levels(left, sizes, around=True, level=True).alias("a"), held.alias("b")
        met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("level", "c0", "c1", "c2")])
        near = met.select(F.col("qid").alias("q"), F.col("pid").alias("p"), _distance("a", "b").alias("d2"), F.col("a.level").alias("level"), limit.alias("most")).filter(F.col("d2") <= F.col("most"))
        found = cut(_nearest(near.drop("most"), k), "nearest")
        # Level 0 spans everything that counts, so its queries are done with what they have.
        done = found.filter((F.col("place") == k) | (F.col("level") == 0)).select(F.col("q").alias("of")).distinct()
        ready = found.join(done, F.col("q").eqNullSafe(F.col("of")), "left_semi").select("q", "p", "d2", "place")
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(done, F.col("qid").eqNullSafe(F.col("of")), "left_anti").filter("level > 0").withColumn("level", F.col("level") - 1), "unmet")
        if left.isEmpty():
            return out


class SpatialIndex:
    """Points kept as a table bucketed by cube, for many joins with the same cutoff: the points' side is then not shuffled again.

    The session's warehouse holds the table under this name; rebuild() replaces it.
    """

    def __init__(self, spark: SparkSession, name: str, cutoff: float, buckets: int = 200):
        if cutoff <= 0:
            raise ValueError("the cutoff must be positive")
        self.spark, self.name, self.cutoff, self.buckets = spark, name, cutoff, buckets

    def rebuild(self, points: DataFrame, point_id: str = "id") -> SpatialIndex:
        rows = cells(_named(points, point_id, "p"), self.cutoff)
        rows.repartition(self.buckets, "c0", "c1", "c2").write.mode("overwrite").bucketBy(self.buckets, "c0", "c1", "c2").sortBy("c0", "c1", "c2").saveAsTable(self.name)
        return self

    def points(self) -> DataFrame:
        return self.spark.table(self.name)

    def join(self, query: DataFrame, cutoff: float | None = None, query_id: str = "id") -> DataFrame:
        """q, p, d2 of all pairs within the cutoff, which is at most the index's."""
        cutoff = self.cutoff if cutoff is None else cutoff
        if not 0 < cutoff <= self.cutoff:
            raise ValueError(f"the cutoff must be positive and at most {self.cutoff}")
        q, p = cells(_named(query, query_id, "q"), self.cutoff, AROUND).alias("q"), self.points().alias("p")
        met = q.join(p, [F.col(f"q.c{i}") == F.col(f"p.c{i}") for i in range(3)])
        return met.select(F.col("qid").alias("q"), F.col("pid").alias("p"), _distance("q", "p").alias("d2")).filter(F.col("d2") <= cutoff * cutoff)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
