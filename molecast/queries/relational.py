"""Queries of the relational operators, with the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.elements import elements, periodic_table
from ..operators import geometry as G
from ..operators import graph as E
from ..operators import spatial as H
from ..operators.components import components
from ..plans.derive import BOND, SQL, bonds, conformers, molecules, pairs, points, table, with_element
from . import query

WITH = f"WITH {SQL}"
RADII = {e.z: (e.cov_radius, e.vdw_radius) for e in periodic_table()}
VALUES = ", ".join(f"({e.z}, '{e.symbol}', {e.cov_radius}::DOUBLE, {e.vdw_radius}::DOUBLE, {e.valence}, {e.period}, {e.grp}, {e.weight}::DOUBLE)" for e in periodic_table())
ELEMENTS = f"el(num, symbol, rcov, rvdw, valence, period, grp, weight) AS (VALUES {VALUES})"


def r6(c):
    return F.round(c, 6)


def numbered(spark, sf_dir):
    return points(spark, sf_dir).withColumnRenamed("vec_id", "id")


# C: accessors and counts


@query(WITH + ", " + ELEMENTS + " SELECT a.vec_id, a.atom_id, e.symbol, e.period, e.grp, e.valence, e.weight FROM atoms a JOIN el e ON e.num = a.elem")
def c1_atom_elements(spark, sf_dir):
    """Atoms with the fields of their element, by broadcast of the fixed table."""
    dim = elements(spark).select("z", "symbol", "period", "grp", "valence", "weight")
    atoms = with_element(conformers(spark, sf_dir))
    return atoms.join(F.broadcast(dim), atoms.elem == dim.z).select("vec_id", "atom_id", "symbol", "period", "grp", "valence", "weight")


@query(WITH + " SELECT vec_id, src, dst, round(sqrt(d2), 6) AS len, round(d2, 6) AS sqlen FROM bonds")
def c2_bond_lengths(spark, sf_dir):
    return bonds(spark, sf_dir).select("vec_id", "src", "dst", r6(F.sqrt("d2")).alias("len"), r6("d2").alias("sqlen"))


@query(WITH + """, parts AS (SELECT vec_id, count(*) AS m FROM bonds GROUP BY 1),
 reach AS (WITH RECURSIVE r(vec_id, a, b) AS (SELECT vec_id, atom_id, atom_id FROM conformers UNION SELECT r.vec_id, r.a, e.dst FROM r JOIN both_ways e ON e.vec_id = r.vec_id AND e.src = r.b) SELECT vec_id, a, min(b) AS label FROM r GROUP BY 1, 2)
 SELECT f.vec_id, 21 AS num_atoms, coalesce(p.m, 0) AS num_bonds, f.n AS num_fragments, coalesce(p.m, 0) - 21 + f.n AS num_sssr FROM (SELECT vec_id, count(DISTINCT label) AS n FROM reach GROUP BY 1) f LEFT JOIN parts p USING (vec_id)""")
def c3_molecule_counts(spark, sf_dir):
    """Atoms, bonds, fragments and the number of rings, bonds - atoms + fragments."""
    own = bonds(spark, sf_dir)
    ids = own.select((F.col("vec_id") * 32 + F.col("src")).alias("a"), (F.col("vec_id") * 32 + F.col("dst")).alias("b"))
    merged = components(ids).filter("node <> label").groupBy((F.floor(F.col("node") / 32)).alias("vec_id")).agg(F.count("*").alias("gone"))
    n = own.groupBy("vec_id").agg(F.count("*").alias("m"))
    all_ = molecules(spark, sf_dir).select("vec_id", F.size("atoms").alias("num_atoms")).join(n, "vec_id", "left").join(merged, "vec_id", "left")
    m, f = F.coalesce("m", F.lit(0)), (F.col("num_atoms") - F.coalesce("gone", F.lit(0)))
    return all_.select("vec_id", "num_atoms", m.alias("num_bonds"), f.alias("num_fragments"), (m - F.col("num_atoms") + f).alias("num_sssr"))


@query(WITH + """ SELECT e.vec_id, e.src AS atom_id, count(*) AS neighbours, count(*) FILTER (n.elem > 1) AS heavy_neighbours, count(*) FILTER (n.elem = 1) AS hydrogens
 FROM both_ways e JOIN atoms n ON n.vec_id = e.vec_id AND n.atom_id = e.dst GROUP BY 1, 2""")
def c4_neighbour_counts(spark, sf_dir):
    """Neighbours, heavy ones and hydrogens of each bonded atom; the element of an atom follows from its ids, so nothing is joined."""
    arcs = E.both_ways(bonds(spark, sf_dir)).withColumn("atom_id", F.col("v"))
    return with_element(arcs).groupBy("vec_id", F.col("u").alias("atom_id")).agg(F.count("*").alias("neighbours"), F.count_if(F.col("elem") > 1).alias("heavy_neighbours"), F.count_if(F.col("elem") == 1).alias("hydrogens"))


@query(f"WITH {ELEMENTS} SELECT num AS z, symbol, period, grp, valence, weight, rcov, rvdw FROM el WHERE period BETWEEN 2 AND 5 AND symbol <> 'Xx'")
def c5_periodic_table(spark, sf_dir):
    return elements(spark).filter("period BETWEEN 2 AND 5").select("z", "symbol", "period", "grp", "valence", "weight", F.col("cov_radius").alias("rcov"), F.col("vdw_radius").alias("rvdw"))


@query("""SELECT event_id, len(map_keys(m)) AS n, array_to_string(list_sort(map_keys(m)), ',') AS names, array_to_string(list_transform(list_sort(map_keys(m)), lambda k: m[k]), ',') AS vals
 FROM (SELECT event_id, CAST(json(props) AS MAP(VARCHAR, VARCHAR)) AS m FROM events)""")
def c6_property_map(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    keys = F.array_sort(F.map_keys("m"))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.size("m").alias("n"), F.concat_ws(",", keys).alias("names"), F.concat_ws(",", F.transform(keys, lambda k: F.try_element_at("m", k))).alias("vals"))


@query(WITH + ", " + ELEMENTS + """, v AS (SELECT vec_id, src AS atom_id, count(*) AS total FROM both_ways GROUP BY 1, 2)
 SELECT a.vec_id, a.atom_id, coalesce(v.total, 0) AS total_valence, e.valence - coalesce(v.total, 0) AS nonbonding, coalesce(v.total, 0) + (e.valence - coalesce(v.total, 0)) // 2 + abs((e.valence - coalesce(v.total, 0)) % 2) AS steric
 FROM atoms a JOIN el e ON e.num = a.elem LEFT JOIN v ON v.vec_id = a.vec_id AND v.atom_id = a.atom_id WHERE e.valence >= coalesce(v.total, 0)""")
def c7_valence(spark, sf_dir):
    """Bond-order sums, non-bonding electrons and steric numbers, of atoms with electrons to spare."""
    sums = E.degrees(bonds(spark, sf_dir)).select("vec_id", F.col("u").alias("atom_id"), "degree")
    dim = elements(spark).select(F.col("z").alias("num"), "valence")
    all_ = with_element(conformers(spark, sf_dir)).join(sums, ["vec_id", "atom_id"], "left").join(F.broadcast(dim), F.col("elem") == F.col("num"))
    total = F.coalesce("degree", F.lit(0))
    left = F.col("valence") - total
    return all_.filter(left >= 0).select("vec_id", "atom_id", total.alias("total_valence"), left.alias("nonbonding"), (total + F.floor(left / 2) + left % 2).alias("steric"))


# D: filters


@query(WITH + """, stay AS (SELECT vec_id, atom_id, elem, row_number() OVER (PARTITION BY vec_id ORDER BY atom_id) - 1 AS new_id FROM atoms WHERE elem <> 1)
 SELECT b.vec_id, s.new_id AS src, d.new_id AS dst FROM bonds b JOIN stay s ON s.vec_id = b.vec_id AND s.atom_id = b.src JOIN stay d ON d.vec_id = b.vec_id AND d.atom_id = b.dst""")
def d1_erase_hydrogens(spark, sf_dir):
    """Bonds after erasing the atoms of element 1, with dense ids."""
    return E.erase_nodes(with_element(conformers(spark, sf_dir)), bonds(spark, sf_dir), F.col("elem") == 1)[1]


@query(WITH + " SELECT a.vec_id, a.atom_id FROM atoms a WHERE EXISTS (SELECT 1 FROM both_ways e WHERE e.vec_id = a.vec_id AND e.src = a.atom_id AND e.dst = 0)")
def d2_bonded_to_first(spark, sf_dir):
    arcs = E.both_ways(bonds(spark, sf_dir)).filter("v = 0").select("vec_id", F.col("u").alias("atom_id"))
    return conformers(spark, sf_dir).join(arcs, ["vec_id", "atom_id"], "left_semi").select("vec_id", "atom_id")


@query(WITH + ", " + ELEMENTS + """, v AS (SELECT vec_id, src AS atom_id, count(*) AS total FROM both_ways GROUP BY 1, 2)
 SELECT a.vec_id, count(*) AS bad FROM atoms a JOIN el e ON e.num = a.elem JOIN v ON v.vec_id = a.vec_id AND v.atom_id = a.atom_id WHERE e.valence < v.total GROUP BY 1""")
def d5_valence_filter(spark, sf_dir):
    """Molecules with atoms that have more bonds than electrons to share."""
    sums = with_element(E.degrees(bonds(spark, sf_dir)).withColumnRenamed("u", "atom_id"))
    dim = elements(spark).select(F.col("z").alias("num"), "valence")
    return sums.join(F.broadcast(dim), F.col("elem") == F.col("num")).filter("valence < degree").groupBy("vec_id").agg(F.count("*").alias("bad"))


# E: graphs


@query(WITH + " SELECT vec_id, src AS u, count(*) AS degree FROM both_ways GROUP BY 1, 2")
def e1_degrees(spark, sf_dir):
    return E.degrees(bonds(spark, sf_dir))


@query(WITH + " SELECT vec_id, src, dst FROM bonds UNION ALL SELECT vec_id, src + 21, dst + 21 FROM bonds WHERE src % 2 = 0")
def e2_merge_graphs(spark, sf_dir):
    own = bonds(spark, sf_dir)
    sizes = molecules(spark, sf_dir).select("vec_id", F.size("atoms").alias("n"))
    return E.merge_graphs(own, own.filter("src % 2 = 0"), sizes)


COMPONENTS = WITH + """, reach AS (WITH RECURSIVE r(vec_id, a, b) AS (SELECT vec_id, src, src FROM both_ways UNION SELECT r.vec_id, r.a, e.dst FROM r JOIN both_ways e ON e.vec_id = r.vec_id AND e.src = r.b) SELECT vec_id, a, min(b) AS label FROM r GROUP BY 1, 2)"""


@query(COMPONENTS + " SELECT vec_id, a AS atom_id, label FROM reach")
def e3_components(spark, sf_dir):
    """Components by the distributed algorithm, over one edge table of all molecules."""
    own = bonds(spark, sf_dir)
    ids = own.select((F.col("vec_id") * 32 + F.col("src")).alias("a"), (F.col("vec_id") * 32 + F.col("dst")).alias("b"))
    return components(ids).select(F.floor(F.col("node") / 32).alias("vec_id"), (F.col("node") % 32).cast("int").alias("atom_id"), (F.col("label") % 32).cast("int").alias("label"))


@query("""SELECT l_orderkey AS node, -max(l_partkey) - 1 AS least_part FROM lineitem GROUP BY 1""")
def e3_bipartite_stars(spark, sf_dir):
    """Each order is tied to one part, so that a component is a part and its orders."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg((-F.max("l_partkey") - 1).alias("b"))
    return components(own).filter("node >= 0").select("node", F.col("label").alias("least_part"))


@query(COMPONENTS + " SELECT vec_id, count(*) AS fragments, sum(n) AS atoms FROM (SELECT vec_id, label, count(*) AS n FROM reach GROUP BY 1, 2) GROUP BY 1")
def e4_fragments(spark, sf_dir):
    return e3_components(spark, sf_dir).groupBy("vec_id").agg(F.countDistinct("label").alias("fragments"), F.count("*").alias("atoms"))


@query(WITH + " SELECT a.vec_id, a.src AS n0, a.dst AS n1, b.dst AS n2 FROM both_ways a JOIN both_ways b ON b.vec_id = a.vec_id AND b.src = a.dst JOIN both_ways c ON c.vec_id = a.vec_id AND c.src = b.dst AND c.dst = a.src")
def e10_triangles(spark, sf_dir):
    """All mappings of a triangle."""
    return E.match_pattern(bonds(spark, sf_dir), [(0, 1), (1, 2), (0, 2)])


@query(WITH + """ SELECT a.vec_id, a.src AS n0, a.dst AS n1, b.dst AS n2 FROM both_ways a JOIN both_ways b ON b.vec_id = a.vec_id AND b.src = a.dst AND b.dst <> a.src
 WHERE NOT EXISTS (SELECT 1 FROM both_ways c WHERE c.vec_id = a.vec_id AND c.src = a.src AND c.dst = b.dst)""")
def e10_induced_path(spark, sf_dir):
    """Paths of three atoms whose ends aren't bonded."""
    return E.match_pattern(bonds(spark, sf_dir), [(0, 1), (1, 2)], "induced")


@query(WITH + """, l AS (SELECT e.vec_id, e.src, e.dst, x.elem AS le, y.elem AS re FROM both_ways e JOIN atoms x ON x.vec_id = e.vec_id AND x.atom_id = e.src JOIN atoms y ON y.vec_id = e.vec_id AND y.atom_id = e.dst)
 SELECT a.vec_id, a.src AS n0, a.dst AS n1, b.dst AS n2 FROM l a JOIN l b ON b.vec_id = a.vec_id AND b.src = a.dst AND b.dst <> a.src WHERE a.le = 6 AND a.re = 7 AND b.re = 8""")
def e10_labelled_path(spark, sf_dir):
    """Carbon, nitrogen, oxygen in a row."""
    return E.match_pattern(bonds(spark, sf_dir), [(0, 1), (1, 2)], nodes=with_element(conformers(spark, sf_dir)), labels={0: 6, 1: 7, 2: 8})


@query(WITH + " SELECT b.vec_id, b.src, b.dst FROM bonds b JOIN atoms s ON s.vec_id = b.vec_id AND s.atom_id = b.src JOIN atoms d ON d.vec_id = b.vec_id AND d.atom_id = b.dst WHERE s.elem IN (6, 7) AND d.elem IN (6, 7)")
def e11_induced_subgraph(spark, sf_dir):
    return E.induced(bonds(spark, sf_dir), with_element(conformers(spark, sf_dir)).filter("elem IN (6, 7)"))


# G: geometry


@query(WITH + " SELECT vec_id, round(sum(sqrt(d2)), 6) AS total, round(max(d2), 6) AS widest FROM pairs GROUP BY 1")
def g1_pair_distances(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("vec_id").agg(r6(F.sum(F.sqrt("d2"))).alias("total"), r6(F.max("d2")).alias("widest"))


ANGLES = WITH + """, v AS (SELECT a.vec_id, a.atom_id, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz, c.x - b.x AS vx, c.y - b.y AS vy, c.z - b.z AS vz, d.x - c.x AS wx, d.y - c.y AS wy, d.z - c.z AS wz
 FROM conformers a JOIN conformers b ON b.vec_id = a.vec_id AND b.atom_id = a.atom_id + 1 JOIN conformers c ON c.vec_id = a.vec_id AND c.atom_id = a.atom_id + 2 JOIN conformers d ON d.vec_id = a.vec_id AND d.atom_id = a.atom_id + 3),
 n AS (SELECT *, -(uy * vz - uz * vy) AS mx, -(uz * vx - ux * vz) AS my, -(ux * vy - uy * vx) AS mz, vy * wz - vz * wy AS nx, vz * wx - vx * wz AS ny, vx * wy - vy * wx AS nz FROM v)"""


@query(ANGLES + " SELECT vec_id, atom_id, round((ux * vx + uy * vy + uz * vz) / sqrt((ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz)), 6) AS cos_angle, round((mx * nx + my * ny + mz * nz) / sqrt((mx * mx + my * my + mz * mz) * (nx * nx + ny * ny + nz * nz)), 6) AS cos_dihedral FROM n")
def g3_angles(spark, sf_dir):
    """Angle and dihedral of each four atoms in a row, read from the row's own array."""
    at = molecules(spark, sf_dir).select("vec_id", "atoms", F.explode(F.sequence(F.lit(0), F.size("atoms") - 4)).alias("atom_id"))
    a, b, c, d = (F.get("atoms", F.col("atom_id") + i) for i in range(4))
    return at.select("vec_id", "atom_id", r6(G.cos_angle(a, b, c)).alias("cos_angle"), r6(G.cos_dihedral(a, b, c, d)).alias("cos_dihedral"))


@query(WITH + " SELECT vec_id, round(0.0 * x - y + 0.5, 6) AS x, round(x + 0.25, 6) AS y, round(2 * z - 1, 6) AS z FROM points")
def g5_transform(spark, sf_dir):
    out = G.transform_points(points(spark, sf_dir), [[0, -1, 0, 0.5], [1, 0, 0, 0.25], [0, 0, 2, -1], [0, 0, 0, 1]])
    return out.select("vec_id", *(r6(c).alias(c) for c in "xyz"))


@query(f"SELECT CAST(i AS INT) AS i, round(sqrt(1 - z * z) * cos(i * {G.TURN!r}::DOUBLE), 6) AS x, round(sqrt(1 - z * z) * sin(i * {G.TURN!r}::DOUBLE), 6) AS y, round(z, 6) AS z FROM (SELECT i, {1 - 1 / 92!r}::DOUBLE - i * {2 / 92!r}::DOUBLE AS z FROM range(92) t(i))")
def g8_fibonacci_lattice(spark, sf_dir):
    return G.fibonacci_lattice(spark, 92).select("i", *(r6(c).alias(c) for c in "xyz"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(64), lambda i: {'v': embedding[i + 1], 'i': i})), lambda s: s.i), ',') AS places FROM embeddings")
def g9_argsort(spark, sf_dir):
    order = F.array_sort(F.transform("embedding", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws(",", F.transform(order, lambda s: s["i"].cast("string"))).alias("places"))


# H: spatial joins

CUT = 0.0371
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(WITH + f" SELECT a.vec_id AS q, b.vec_id AS p, round({D2}, 6) AS d2 FROM points a JOIN points b ON {D2} <= {CUT} * {CUT}")
def h1_range_join(spark, sf_dir):
    """All points against all, each with itself too."""
    p = numbered(spark, sf_dir)
    return H.distance_join(p, p, CUT).select("q", "p", r6("d2").alias("d2"))


KNN = WITH + f", d AS (SELECT a.vec_id AS q, b.vec_id AS p, {D2} AS d2 FROM points a, points b), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS place FROM d"


@query(KNN + ") SELECT q, p, place, round(d2, 6) AS d2 FROM r WHERE place <= 4")
def h2_knn_join(spark, sf_dir):
    p = numbered(spark, sf_dir)
    return H.knn_join(p, p, 4).select("q", "p", "place", r6("d2").alias("d2"))


@query(KNN + " WHERE d2 <= 0.09 * 0.09) SELECT q, p, place, round(d2, 6) AS d2 FROM r WHERE place <= 4")
def h2_knn_within(spark, sf_dir):
    p = numbered(spark, sf_dir)
    return H.knn_join(p, p, 4, 0.09).select("q", "p", "place", r6("d2").alias("d2"))


@query(WITH + f" SELECT a.vec_id AS q, coalesce(array_to_string(list_sort(list(b.vec_id) FILTER (b.vec_id IS NOT NULL)), ','), '') AS neighbours FROM points a LEFT JOIN points b ON {D2} <= {CUT} * {CUT} GROUP BY 1")
def h3_neighbour_lists(spark, sf_dir):
    """Neighbours of each point."""
    p = numbered(spark, sf_dir)
    return H.neighbour_lists(p, p, CUT).select("q", F.concat_ws(",", F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours"))


@query(WITH + f" SELECT a.vec_id AS a, b.vec_id AS b, round({D2}, 6) AS d2 FROM points a JOIN points b ON a.vec_id < b.vec_id AND {D2} <= {CUT} * {CUT}")
def h4_pairs(spark, sf_dir):
    return H.self_join(numbered(spark, sf_dir), CUT).select("a", "b", r6("d2").alias("d2"))


@query(WITH + " SELECT vec_id, count(*) AS n FROM bonds GROUP BY 1")
def h4_pairs_by_conformer(spark, sf_dir):
    """Atom pairs within the bond distance, for each conformer."""
    return bonds(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("n"))


@query(WITH + ", " + ELEMENTS + """ SELECT a.vec_id, a.atom_id AS src, b.atom_id AS dst FROM atoms a JOIN el ea ON ea.num = a.elem JOIN atoms b ON b.vec_id = a.vec_id AND a.atom_id < b.atom_id JOIN el eb ON eb.num = b.elem
 WHERE 144 * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= (ea.rcov + eb.rcov + 0.1) * (ea.rcov + eb.rcov + 0.1)""")
def h6_covalent_join(spark, sf_dir):
    """Pairs no farther apart than their covalent radii and a tolerance say."""
    radius = F.create_map(*(F.lit(v) for z in (1, 6, 7, 8, 16) for v in (z, RADII[z][0])))
    p = pairs(spark, sf_dir)
    reach = sum((radius[F.array(*map(F.lit, (6, 7, 8, 16, 1)))[((F.col(c) + F.col("vec_id")) % 5).cast("int")]] for c in ("src", "dst")), F.lit(0.0)) + 0.1
    return p.filter(144 * F.col("d2") <= reach * reach).select("vec_id", "src", "dst")


# J, K: aggregations, sorts, sets


@query(WITH + " SELECT vec_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(min(x), 6) AS lx, round(max(x), 6) AS hx, round(sqrt(avg(x * x + y * y + z * z)), 6) AS rms FROM conformers GROUP BY 1")
def j5_centroids(spark, sf_dir):
    x, y, z = map(F.col, "xyz")
    return conformers(spark, sf_dir).groupBy("vec_id").agg(r6(F.avg(x)).alias("cx"), r6(F.avg(y)).alias("cy"), r6(F.avg(z)).alias("cz"), r6(F.min(x)).alias("lx"), r6(F.max(x)).alias("hx"), r6(F.sqrt(F.avg(x * x + y * y + z * z))).alias("rms"))


@query(WITH + " SELECT vec_id, atom_id, CAST(floor(12 * sqrt(d2)) AS INT) AS shell, count(*) AS n FROM (SELECT vec_id, src AS atom_id, d2 FROM pairs UNION ALL SELECT vec_id, dst, d2 FROM pairs) GROUP BY 1, 2, 3")
def j6_shell_histogram(spark, sf_dir):
    """Neighbours of each atom by whole-number shells of distance, all of them."""
    p = pairs(spark, sf_dir)
    ends = p.select("vec_id", F.explode(F.array("src", "dst")).alias("atom_id"), F.floor(12 * F.sqrt("d2")).cast("int").alias("shell"))
    return ends.groupBy("vec_id", "atom_id", "shell").agg(F.count("*").alias("n"))


@query("SELECT user_id, min(event_id) AS first_event, arg_max(event_type, (value, -event_id)) AS top_type, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, count(*) AS n FROM events GROUP BY 1")
def j3_best_of_group(spark, sf_dir):
    """Like the site of the highest occupancy: the first of the largest, and the distinct kinds."""
    best = F.max_by("event_type", F.struct("value", -F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), best.alias("top_type"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("kinds"), F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN n > 1 THEN base || k ELSE base END AS name FROM (SELECT s_suppkey, base, row_number() OVER (PARTITION BY base ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY base) AS n
 FROM (SELECT s_suppkey, 'N' || s_nationkey || CASE WHEN s_acctbal < 0 THEN 'X' ELSE '' END AS base FROM supplier))""")
def b9_unique_names(spark, sf_dir):
    """Names that occur more than once are numbered from 1, in order."""
    base = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.when(F.col("s_acctbal") < 0, "X").otherwise(""))
    w = Window.partitionBy("base")
    named = table(spark, sf_dir, "supplier").select("s_suppkey", base.alias("base")).withColumn("k", F.row_number().over(w.orderBy("s_suppkey"))).withColumn("n", F.count("*").over(w))
    return named.select("s_suppkey", F.when(F.col("n") > 1, F.concat("base", F.col("k").cast("string"))).otherwise(F.col("base")).alias("name"))


@query(WITH + " SELECT vec_id, atom_id, row_number() OVER (PARTITION BY vec_id ORDER BY elem DESC, atom_id) AS place FROM atoms")
def k1_stable_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("elem"), "atom_id"))
    return with_element(conformers(spark, sf_dir)).select("vec_id", "atom_id", place.alias("place"))


@query(WITH + " SELECT vec_id, round(sum(d2), 6) AS score FROM pairs GROUP BY 1 ORDER BY sum(d2) DESC, vec_id LIMIT 10")
def k2_top_conformers(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("vec_id").agg(F.sum("d2").alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", r6("s").alias("score"))


@query(WITH + """, l AS (SELECT vec_id, list_sort(list_distinct(list(src))) AS a, list_sort(list_distinct(list(dst))) AS b FROM bonds GROUP BY 1)
 SELECT vec_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a FROM l""")
def k5_index_sets(spark, sf_dir):
    """Union and difference of sorted index sets."""
    s = bonds(spark, sf_dir).groupBy("vec_id").agg(F.collect_set("src").alias("a"), F.collect_set("dst").alias("b"))
    def text(c):
        return F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x.cast("string")))
    return s.select("vec_id", text(F.array_union("a", "b")).alias("either"), text(F.array_except("a", "b")).alias("only_a"))


# L: descriptors


@query(WITH + """, w AS (SELECT *, lag(x, 2) OVER o AS ax, lag(y, 2) OVER o AS ay, lag(z, 2) OVER o AS az, lag(x) OVER o AS bx, lag(y) OVER o AS by_, lag(z) OVER o AS bz, lead(x) OVER o AS dx, lead(y) OVER o AS dy, lead(z) OVER o AS dz, lead(x, 2) OVER o AS ex, lead(y, 2) OVER o AS ey, lead(z, 2) OVER o AS ez
 FROM (SELECT vec_id, atom_id, 25 * x AS x, 25 * y AS y, 25 * z AS z FROM conformers) WINDOW o AS (PARTITION BY vec_id ORDER BY atom_id)),
 d AS (SELECT vec_id, atom_id, sqrt((ax - x) ** 2 + (ay - y) ** 2 + (az - z) ** 2) AS d0, sqrt((ax - dx) ** 2 + (ay - dy) ** 2 + (az - dz) ** 2) AS d1, sqrt((ax - ex) ** 2 + (ay - ey) ** 2 + (az - ez) ** 2) AS d2, sqrt((bx - dx) ** 2 + (by_ - dy) ** 2 + (bz - dz) ** 2) AS d3, sqrt((bx - ex) ** 2 + (by_ - ey) ** 2 + (bz - ez) ** 2) AS d4, sqrt((x - ex) ** 2 + (y - ey) ** 2 + (z - ez) ** 2) AS d5 FROM w)
 SELECT vec_id, atom_id, CASE WHEN d2 IS NULL THEN 'coil' WHEN abs(d0 - 5.45) < 2.1 AND abs(d1 - 5.18) < 2.1 AND abs(d2 - 6.37) < 2.1 AND abs(d3 - 5.45) < 2.1 AND abs(d4 - 5.18) < 2.1 AND abs(d5 - 5.45) < 2.1 THEN 'helix'
 WHEN abs(d0 - 6.1) < 1.42 AND abs(d1 - 10.4) < 1.42 AND abs(d2 - 13) < 1.42 AND abs(d3 - 6.1) < 1.42 AND abs(d4 - 10.4) < 1.42 AND abs(d5 - 6.1) < 1.42 THEN 'strand' WHEN d2 < 8 THEN 'turn' ELSE 'coil' END AS ss FROM d""")
def l5_secondary_structure(spark, sf_dir):
    wide = conformers(spark, sf_dir).select("vec_id", "atom_id", *((25 * F.col(c)).alias(c) for c in "xyz"))
    return G.secondary_structure(wide, "vec_id", "atom_id").select("vec_id", "atom_id", "ss")


@query(WITH + ", " + ELEMENTS + f""", s AS (SELECT vec_id, atom_id, elem, 12 * x AS x, 12 * y AS y, 12 * z AS z, 0.8 * rvdw AS r FROM atoms JOIN el ON el.num = elem),
 p AS (SELECT a.vec_id, a.elem AS ea, b.elem AS eb, a.r AS ra, b.r AS rb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, round(sum(CASE WHEN ra + rb - d <= 0 THEN 0 WHEN d <= abs(ra - rb) THEN least(ra, rb) * least(ra, rb) * least(ra, rb) * {4 * math.pi / 3!r} ELSE {math.pi / 12!r} * (ra + rb - d) * (ra + rb - d) * (d + 2 * (ra + rb) - 3 / d * (ra - rb) * (ra - rb)) END * CASE WHEN ea = eb THEN 1 ELSE 0.7 END), 4) AS overlap FROM p GROUP BY 1""")
def l8_shape_overlap(spark, sf_dir):
    """Shared volume of each conformer with the next one."""
    dim = elements(spark).select(F.col("z").alias("num"), (0.8 * F.col("vdw_radius")).alias("r"))
    s = with_element(conformers(spark, sf_dir)).join(F.broadcast(dim), F.col("elem") == F.col("num")).select("vec_id", "elem", "r", *((12 * F.col(c)).alias(c) for c in "xyz"))
    a, b = s.alias("a"), s.select((F.col("vec_id") - 1).alias("vec_id"), "elem", "r", "x", "y", "z").alias("b")
    d = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"]
    vol = G.lens_volume(F.col("a.r"), F.col("b.r"), F.sqrt(G.dot(d, d))) * F.when(F.col("a.elem") == F.col("b.elem"), 1.0).otherwise(0.7)
    return a.join(b, F.col("a.vec_id") == F.col("b.vec_id")).groupBy(F.col("a.vec_id").alias("vec_id")).agg(F.round(F.sum(vol), 4).alias("overlap"))


@query(WITH + ", " + ELEMENTS + f""", s AS (SELECT vec_id, atom_id, 12 * x AS x, 12 * y AS y, 12 * z AS z, rvdw + 1.4 AS r FROM atoms JOIN el ON el.num = elem),
 l AS (SELECT sqrt(1 - z * z) * cos(i * {G.TURN!r}) AS px, sqrt(1 - z * z) * sin(i * {G.TURN!r}) AS py, z AS pz FROM (SELECT i, {1 - 1 / 92!r}::DOUBLE - i * {2 / 92!r}::DOUBLE AS z FROM range(92) t(i)))
 SELECT s.vec_id, s.atom_id, CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM s o WHERE o.vec_id = s.vec_id AND o.atom_id <> s.atom_id AND (s.x + s.r * px - o.x) * (s.x + s.r * px - o.x) + (s.y + s.r * py - o.y) * (s.y + s.r * py - o.y) + (s.z + s.r * pz - o.z) * (s.z + s.r * pz - o.z) <= o.r * o.r)) AS INT) AS free FROM s, l GROUP BY 1, 2""")
def l3_open_probes(spark, sf_dir):
    """Unblocked probes of each atom's sphere."""
    dim = elements(spark).select(F.col("z").alias("num"), (F.col("vdw_radius") + 1.4).alias("r"))
    s = with_element(conformers(spark, sf_dir)).join(F.broadcast(dim), F.col("elem") == F.col("num")).select("vec_id", "atom_id", "r", *((12 * F.col(c)).alias(c) for c in "xyz"))
    return G.surface_area(s, 92, "vec_id", "atom_id").select("vec_id", "atom_id", F.col("open").alias("free"))


# More of the inventory: joins within parsers, groupings, sets, merges


@query(WITH + " SELECT b.vec_id, b.src, b.dst, s.elem AS src_elem, d.elem AS dst_elem, round(d.x - s.x, 6) AS dx FROM bonds b JOIN atoms s ON s.vec_id = b.vec_id AND s.atom_id = b.src JOIN atoms d ON d.vec_id = b.vec_id AND d.atom_id = b.dst")
def i1_two_sided_join(spark, sf_dir):
    """Links whose ends are both looked up among the sites, by a key of two columns."""
    sites = with_element(conformers(spark, sf_dir)).select("vec_id", "atom_id", "elem", "x")
    links, s, d = bonds(spark, sf_dir).alias("b"), sites.alias("s"), sites.alias("d")
    met = links.join(s, (F.col("s.vec_id") == F.col("b.vec_id")) & (F.col("s.atom_id") == F.col("b.src"))).join(d, (F.col("d.vec_id") == F.col("b.vec_id")) & (F.col("d.atom_id") == F.col("b.dst")))
    return met.select("b.vec_id", "b.src", "b.dst", F.col("s.elem").alias("src_elem"), F.col("d.elem").alias("dst_elem"), r6(F.col("d.x") - F.col("s.x")).alias("dx"))


@query(WITH + " SELECT c.vec_id, c.atom_id, b.n FROM conformers c LEFT JOIN (SELECT vec_id, src AS atom_id, count(*) AS n FROM bonds GROUP BY 1, 2) b USING (vec_id, atom_id)")
def i3_optional_join(spark, sf_dir):
    """Atoms with what a later record says of them, if any does."""
    said = bonds(spark, sf_dir).groupBy("vec_id", F.col("src").alias("atom_id")).agg(F.count("*").alias("n"))
    return conformers(spark, sf_dir).select("vec_id", "atom_id").join(said, ["vec_id", "atom_id"], "left")


@query(WITH + " SELECT vec_id, atom_id FROM conformers c WHERE EXISTS (SELECT 1 FROM bonds b WHERE b.vec_id = c.vec_id AND b.src = c.atom_id)")
def i4_listed_only(spark, sf_dir):
    """Only those that a list names stay."""
    named = bonds(spark, sf_dir).select("vec_id", F.col("src").alias("atom_id"))
    return conformers(spark, sf_dir).select("vec_id", "atom_id").join(named, ["vec_id", "atom_id"], "left_semi")


@query(f"WITH {ELEMENTS} SELECT n_nationkey, n_name, e.num AS z FROM nation LEFT JOIN el e ON upper(e.symbol) = upper(substr(n_name, 1, 2))")
def i6_symbol_lookup(spark, sf_dir):
    """Elements by symbol, without case."""
    dim = elements(spark).select(F.upper("symbol").alias("key"), "z")
    return table(spark, sf_dir, "nation").join(F.broadcast(dim), F.upper(F.substring("n_name", 1, 2)) == F.col("key"), "left").select("n_nationkey", "n_name", "z")


@query(f"WITH {ELEMENTS} SELECT num AS z, symbol FROM el WHERE num >= (SELECT num FROM el WHERE symbol = 'C') AND num < (SELECT num FROM el WHERE symbol = 'Fe')")
def d4_element_range(spark, sf_dir):
    """Elements from carbon up to iron."""
    return elements(spark).filter("z >= 6 AND z < 26").select("z", "symbol")


@query("""SELECT user_id, array_to_string(list(event_type ORDER BY event_id), '>') AS types, min(event_id) AS first_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1""")
def j2_first_seen_groups(spark, sf_dir):
    """Groups with their members in order of appearance."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("m"), F.min("event_id").alias("first_id"), F.countDistinct("event_type").alias("kinds"))
    return rows.select("user_id", F.array_join(F.transform("m", lambda x: x["event_type"]), ">").alias("types"), "first_id", "kinds")


@query(WITH + " SELECT vec_id, array_to_string(list_sort(list(DISTINCT elem)), ',') AS kinds FROM atoms GROUP BY 1")
def j4_distinct_kinds(spark, sf_dir):
    return with_element(conformers(spark, sf_dir)).groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("elem")), lambda x: x.cast("string")), ",").alias("kinds"))


@query(WITH + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2 DESC, src, dst) AS place, count(*) OVER (PARTITION BY vec_id) AS n FROM pairs) SELECT vec_id, src, dst FROM r WHERE place > ceil(0.1 * n)")
def k3_drop_the_worst(spark, sf_dir):
    """All pairs but the tenth that is farthest apart."""
    w = Window.partitionBy("vec_id")
    own = pairs(spark, sf_dir).withColumn("place", F.row_number().over(w.orderBy(F.desc("d2"), "src", "dst"))).withColumn("n", F.count("*").over(w))
    return own.filter(F.col("place") > F.ceil(F.lit(0.1) * F.col("n"))).select("vec_id", "src", "dst")


@query(WITH + " SELECT vec_id, atom_id, round(x, 6) AS x FROM conformers UNION ALL SELECT vec_id - 1, atom_id + 21, round(x, 6) FROM conformers WHERE vec_id > 0")
def k6_merge_molecules(spark, sf_dir):
    """Each molecule with the next one's atoms after its own."""
    own = molecules(spark, sf_dir)
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("atoms").alias("more")).filter("vec_id >= 0")
    met = own.join(after, "vec_id", "left").select("vec_id", F.concat("atoms", F.coalesce("more", F.slice("atoms", 1, 0))).alias("atoms"))
    return met.select("vec_id", F.posexplode("atoms").alias("atom_id", "a")).select("vec_id", "atom_id", r6("a.x").alias("x"))


@query("SELECT key, count(*) AS n FROM (SELECT '_' || replace(p_brand, '#', '.') AS key FROM part) GROUP BY 1 HAVING count(*) > 1")
def b8_duplicate_keys(spark, sf_dir):
    """Keys that come more than once."""
    keys = table(spark, sf_dir, "part").select(F.concat(F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("."))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
