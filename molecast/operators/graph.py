"""Relational graph operators over edge tables keyed by molecule: (mol, src, dst), undirected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY, ENDS = "vec_id", ("src", "dst")


def both_ways(edges: DataFrame, key: str = KEY) -> DataFrame:
    """Each edge from either end, made by one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select(key, F.explode(ends).alias("e")).select(key, "e.u", "e.v")


def degrees(edges: DataFrame, key: str = KEY) -> DataFrame:
    return both_ways(edges, key).groupBy(key, "u").agg(F.count("*").alias("degree"))


def merge_graphs(left: DataFrame, right: DataFrame, left_nodes: DataFrame, key: str = KEY) -> DataFrame:
    """Edges of both graphs; the right one's node ids go on from the left one's nodes (key, n)."""
    shifted = right.join(left_nodes, key).select(key, (F.col("src") + F.col("n")).alias("src"), (F.col("dst") + F.col("n")).alias("dst"))
    return left.select(key, "src", "dst").union(shifted)


def unique_edges(edges: DataFrame, key: str = KEY) -> DataFrame:
    """One row for each pair of ends, in either direction; loops go."""
    return edges.filter("src <> dst").select(key, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def induced(edges: DataFrame, nodes: DataFrame, key: str = KEY, node: str = "atom_id") -> DataFrame:
    """The edges with both ends among the nodes (key, node)."""
    for end in ENDS:
        edges = edges.join(nodes.select(key, F.col(node).alias(end)), [key, end], "left_semi")
    return edges.select(key, "src", "dst")


def erase_nodes(nodes: DataFrame, edges: DataFrame, drop: Column, key: str = KEY, node: str = "atom_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes for which drop holds; ids are dense again, in the old order."""
    stay = nodes.filter(~drop).withColumn("new_id", F.row_number().over(Window.partitionBy(key).orderBy(node)) - 1)
    ids = stay.select(key, node, "new_id")
    for end in ENDS:
        edges = edges.join(ids.select(key, F.col(node).alias(end), F.col("new_id").alias(f"new_{end}")), [key, end])
    return stay, edges.select(key, F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def match_pattern(edges: DataFrame, pattern: list[tuple[int, int]], mode: str = "subgraph", nodes: DataFrame | None = None, labels: dict[int, int] | None = None, key: str = KEY, node: str = "atom_id", label: str = "elem") -> DataFrame:
    """All mappings of a connected pattern's nodes to a molecule's, as columns n0, n1, ..

    A chain of self-joins on the edges, by key and the vertex shared with what is
    matched already. ``induced`` forbids edges that the pattern lacks; ``graph`` also
    wants as many nodes. Labels (pattern node to value of ``label``) filter nodes.
    """
    arcs = both_ways(edges, key)
    count = 1 + max(map(max, pattern))
    if labels and nodes is not None:
        named = nodes.select(key, F.col(node).alias("u"), F.col(label).alias("lu"))
        arcs = arcs.join(named, [key, "u"]).join(named.select(key, F.col("u").alias("v"), F.col("lu").alias("lv")), [key, "v"])
    wants = labels or {}
    todo, known, out = list(pattern), set(), None
    while todo:
        a, b = next((e if e[0] in known else e[::-1]) for e in todo if not known or known & set(e)) if known else todo[0]
        todo = [e for e in todo if set(e) != {a, b}]
        step = arcs.select(key, F.col("u").alias(f"n{a}"), F.col("v").alias(f"n{b}"), *(["lu", "lv"] if wants else []))
        for p, c in ((a, "lu"), (b, "lv")):
            if p in wants:
                step = step.filter(F.col(c) == wants[p])
        step = step.drop("lu", "lv")
        shared = [key, *(f"n{p}" for p in (a, b) if p in known)]
        out = step if out is None else out.join(step, shared)
        new = {a, b} - known
        for p in new:
            for q in known - {p}:
                out = out.filter(F.col(f"n{p}") != F.col(f"n{q}"))
        known |= {a, b}
    if mode in ("induced", "graph"):
        for p in range(count):
            for q in range(p):
                if not any({p, q} == set(e) for e in pattern):
                    gap = arcs.select(F.col(key).alias("gk"), F.col("u").alias("gu"), F.col("v").alias("gv"))
                    out = out.join(gap, (F.col(key) == F.col("gk")) & (F.col(f"n{p}") == F.col("gu")) & (F.col(f"n{q}") == F.col("gv")), "left_anti")
    if mode == "graph":
        sizes = nodes.groupBy(key).agg(F.count("*").alias("size")).filter(F.col("size") == count)
        out = out.join(sizes, key, "left_semi")
    return out.select(key, *(f"n{p}" for p in range(count)))
