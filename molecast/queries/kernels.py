"""Queries of the formats and the per-molecule kernels."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ..functions import cif
from ..functions import coordinates as X
from ..functions import descriptors as D
from ..functions import molecule as M
from ..functions import pdb as P
from ..functions import sdf
from ..functions import substructures as S
from ..functions.chains import align_chains
from ..functions.elements import periodic_table
from ..functions.guess2d import guess_charges, guess_hydrogens
from ..functions.kernels import map_rows, spread
from ..functions.optimize import bfgs, l_bfgs_b, nelder_mead
from ..functions.perception import sanitize
from ..operators import geometry as G
from ..plans.derive import CYCLE, SQL, bonded, molecules, table
from ..sources import mmcif as C
from ..sources.molecules import format_column, parse_column
from . import query
from .relational import ELEMENTS

WITH = f"WITH {SQL}"

#: Lines, and facts about them: heavy atoms, bonds, hydrogens, rings, aromatic atoms, charge.
CORPUS = (
    ("CC ethane", 2, 1, 6, 0, 0, 0), ("C#N hydrogen cyanide", 2, 1, 1, 0, 0, 0), ("CC(=O)[O-] acetate", 4, 3, 3, 0, 0, -1), ("c1ccccc1 benzene", 6, 6, 6, 1, 6, 0), ("C1=CC=CC=C1 benzene", 6, 6, 6, 1, 6, 0),
    ("c1ccc2CCCc2c1 indane", 9, 10, 10, 2, 6, 0), ("C[C@@H](C(=O)O)N alanine", 6, 5, 7, 0, 0, 0), ("[Na+].[Cl-] sodium chloride", 2, 0, 0, 0, 0, 0), ("F/C=C/F difluoroethene", 4, 3, 2, 0, 0, 0), ("[13CH4] methane", 1, 0, 4, 0, 0, 0),
    ("C%12CCCCC%12 cyclohexane", 6, 6, 12, 1, 0, 0), ("OS(=O)(=S)O thiosulfate", 5, 4, 2, 0, 0, 0), ("c1cc[nH]c1 pyrrole", 5, 5, 5, 1, 5, 0), ("c1ccsc1 thiophene", 5, 5, 4, 1, 5, 0), ("NC(=[NH2+])N.[Cl-] guanidinium chloride", 5, 3, 6, 0, 0, 0),
    ("c1ccc2ccccc2c1 naphthalene", 10, 11, 8, 2, 10, 0), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C caffeine", 14, 15, 10, 2, 9, 0), ("C12C3C4C1C5C2C3C45 cubane", 8, 12, 8, 5, 0, 0), ("[N+](=O)([O-])c1ccccc1 nitrobenzene", 9, 9, 5, 1, 6, 0), ("C1CCCC2C1CCCC2 decalin", 10, 11, 18, 2, 0, 0),
)
FACTS = ", ".join(f"({i}, " + ", ".join(str(v) for v in row[1:]) + ")" for i, row in enumerate(CORPUS))
#: A line for each part: two of the lines above, by its key, and a chain. Facts of separate molecules add up.
LINES = f"""facts(i, atoms, bonds, hydrogens, rings, aromatic, charge) AS (VALUES {FACTS}),
chains AS (SELECT p_partkey AS key, p_partkey % 20 AS i, (p_partkey // 20) % 20 AS j, 1 + p_partkey % 7 AS c FROM part),
lines AS (SELECT key, 'part ' || key AS name, a.atoms + b.atoms + c AS atoms, a.bonds + b.bonds + c - 1 AS bonds, a.hydrogens + b.hydrogens + 2 * c + 2 AS hydrogens, a.rings + b.rings AS rings, a.aromatic + b.aromatic AS aromatic, a.charge + b.charge AS charge, a.i AS first, b.i AS second
 FROM chains JOIN facts a ON a.i = chains.i JOIN facts b ON b.i = chains.j)"""


def corpus(spark, sf_dir):
    """key, line: a line for each part."""
    known = F.array(*(F.lit(row[0].split()[0]) for row in CORPUS))
    key = F.col("p_partkey")
    line = F.concat(F.get(known, (key % 20).cast("int")), F.lit("."), F.get(known, F.floor(key / 20).cast("int") % 20), F.lit("."), F.repeat(F.lit("C"), (1 + key % 7).cast("int")), F.lit(" part "), key.cast("string"))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), 1 << 16).select(key.alias("key"), line.alias("line"))


def facts(df):
    """Name, counts and charge of parsed molecules."""
    a = F.col("mol.atoms")
    total = F.aggregate(a, F.lit(0), lambda t, x: t + x["fcharge"])
    h = F.aggregate(a, F.lit(0), lambda t, x: t + x["impl_h"])
    return df.select(*df.columns[:-2], F.col("mol.name").alias("name"), F.size(a).alias("atoms"), F.size("mol.bonds").alias("bonds"), h.alias("hydrogens"), (F.size("mol.bonds") - F.size(a) + F.col("mol.num_fragments")).alias("rings"), F.size(F.filter(a, lambda x: x["aromatic"])).alias("aromatic"), total.alias("charge"))


FACT_COLUMNS = "name, atoms, bonds, hydrogens, rings, aromatic, charge"


@query(f"WITH {LINES} SELECT key, {FACT_COLUMNS} FROM lines")
def a6_read_smiles(spark, sf_dir):
    """Lines parsed and sanitised (also F1 to F5)."""
    return facts(parse_column(corpus(spark, sf_dir), "smi", "line", "key long"))


@query(f"WITH {LINES} SELECT key, {FACT_COLUMNS} FROM lines")
def b1_write_smiles(spark, sf_dir):
    """Lines parsed, written, and parsed again."""
    text = format_column(parse_column(corpus(spark, sf_dir), "smi", "line", "key long"), "smi", keep="key long")
    return facts(parse_column(text, "smi", "value", "key long"))


@query(f"WITH {LINES} SELECT key, {FACT_COLUMNS} FROM lines")
def b2_sdf_of_smiles(spark, sf_dir):
    """Lines parsed, written as connection tables, and read."""
    own = parse_column(corpus(spark, sf_dir), "smi", "line", "key long")
    return facts(parse_column(format_column(own, "sdf", keep="key long"), "sdf", "value", "key long"))


@query(f"WITH {LINES} SELECT key, {FACT_COLUMNS} FROM lines")
def a9_extended_tables(spark, sf_dir):
    """Lines parsed, written as extended connection tables, and read."""
    def kernel(row):
        yield {"key": row["key"], "value": sdf.write_sdf(M.from_row(row["mol"]), version=3000)}

    own = map_rows(parse_column(corpus(spark, sf_dir), "smi", "line", "key long"), kernel, "key long, value string")
    return facts(parse_column(own, "sdf", "value", "key long"))


@query(f"WITH {LINES} SELECT key, round(CAST(charge AS DOUBLE), 5) AS total FROM lines")
def f12_charge_totals(spark, sf_dir):
    """Partial charges add up to the formal charge, once hydrogens are atoms of their own; without a type for some atom there is no total."""
    def kernel(row):
        mol = M.from_row(row["mol"])
        explicit = M.reveal_hydrogens(mol)
        sanitize(explicit)
        failed = D.gasteiger(explicit)
        yield {"key": row["key"], "total": None if failed else round(sum(a.pcharge for a in explicit.atoms), 5) + 0.0}

    return map_rows(parse_column(corpus(spark, sf_dir), "smi", "line", "key long"), kernel, "key long, total double")


def bare(mol, hydrogens=False, charges=False):
    """The elements and bonds of a molecule, and what is asked for."""
    out = M.Molecule()
    for a in mol.atoms:
        out.add_atom(M.Atom(a.z, impl_h=a.impl_h if hydrogens else 0, fcharge=a.fcharge if charges else 0))
    for b in mol.bonds:
        out.add_bond(b.src, b.dst, b.bo)
    return out.finish()


@query(f"WITH {LINES} SELECT key, hydrogens, charge, charge AS sum_of_both FROM lines")
def f11_drawn_structures(spark, sf_dir):
    """Hydrogens found from bonds and charges, charges from bonds and hydrogens, and both at once give the same charge of the whole where ions tell it."""
    def kernel(row):
        mol = M.from_row(row["mol"])
        hydrogens, charges = bare(mol, charges=True), bare(mol, hydrogens=True)
        guess_hydrogens(hydrogens)
        guess_charges(charges)
        again = bare(mol, charges=True)
        again_h = [a.impl_h for a in hydrogens.atoms]
        for a, h in zip(again.atoms, again_h, strict=True):
            a.impl_h, a.fcharge = h, 0
        guess_charges(again)
        yield {"key": row["key"], "hydrogens": sum(again_h), "charge": sum(a.fcharge for a in charges.atoms), "sum_of_both": sum(a.fcharge for a in again.atoms)}

    return map_rows(parse_column(corpus(spark, sf_dir), "smi", "line", "key long"), kernel, "key long, hydrogens int, charge int, sum_of_both int")


@query(WITH + """, n AS (SELECT vec_id, count(*) FILTER (src % 2 = 0 AND dst % 2 = 0) AS even, count(*) FILTER (src > 10 AND dst > 10) AS late FROM bonds GROUP BY 1)
 SELECT e.vec_id, 11 AS atoms, coalesce(n.even, 0) AS bonds, coalesce(n.late, 0) AS later_bonds, '0,2' AS holders, 3 AS subs, 9 AS after_erasing FROM embeddings e LEFT JOIN n USING (vec_id)""")
def c8_substructures(spark, sf_dir):
    """Substructures added, asked and changed as columns: the even atoms, and those after the tenth; the residue comes first."""
    mol = F.col("mol")
    ids = F.sequence(F.lit(0), F.lit(20))
    grown = S.append(S.insert(mol, 1, S.new(F.filter(ids, lambda i: i > 10), "late", 1)), S.new(F.filter(ids, lambda i: i % 2 == 0), "even", 2))
    held = drawn(spark, sf_dir).select("vec_id", grown.alias("mol"))
    erased = S.erase_atoms(S.remove(mol, 1), 1, F.array(F.lit(0), F.lit(2), F.lit(3)))
    return held.select("vec_id", F.size(S.atoms(mol, 2)).alias("atoms"), F.size(S.bonds(mol, 2)).alias("bonds"), F.size(S.bonds(mol, 1)).alias("later_bonds"), F.array_join(F.transform(S.holders(mol, 4), lambda i: i.cast("string")), ",").alias("holders"), F.size("mol.subs").alias("subs"), F.size(S.atoms(erased, 1)).alias("after_erasing"))


def drawn(spark, sf_dir):
    """vec_id, mol: the derived conformers as molecules, with coordinates 12 times as large, their bonds, and one residue."""
    rows = spread(bonded(spark, sf_dir))

    def kernel(row):
        mol = M.Molecule()
        mol.name = f"conformer {row['vec_id']}"
        for i in range(len(row["atoms"])):
            mol.add_atom(M.Atom(CYCLE[(i + row["vec_id"]) % 5]))
        for b in row["bonds"]:
            mol.add_bond(b["src"], b["dst"])
        mol.confs = [12 * np.array([[a["x"], a["y"], a["z"]] for a in row["atoms"]])]
        mol.subs = [{"name": "LIG", "id": row["vec_id"] % 1000, "category": 1, "atom_ids": list(range(len(mol.atoms))), "props": {"chain": "A"}}]
        yield {"vec_id": row["vec_id"], "mol": M.to_row(mol.finish())}

    return map_rows(rows, kernel, f"vec_id long, mol {M.SCHEMA}")


def placed(df, digits):
    """Atoms of parsed molecules with their element and position."""
    at = df.select("vec_id", F.posexplode("mol.atoms").alias("atom_id", "a"), F.col("mol.confs")[0].alias("c"))
    return at.select("vec_id", "atom_id", F.col("a.z").alias("elem"), *(F.round(F.get("c", 3 * F.col("atom_id") + i), digits).alias(c) for i, c in enumerate("xyz")))


def placed_sql(digits):
    return WITH + f" SELECT vec_id, atom_id, elem, round(12 * x, {digits}) AS x, round(12 * y, {digits}) AS y, round(12 * z, {digits}) AS z FROM atoms"


@query(placed_sql(4))
def a8_sdf_round_trip(spark, sf_dir):
    return placed(parse_column(format_column(drawn(spark, sf_dir), "sdf", keep="vec_id long"), "sdf", "value", "vec_id long", clean=False), 4)


@query(placed_sql(4))
def a12_mol2_round_trip(spark, sf_dir):
    return placed(parse_column(format_column(drawn(spark, sf_dir), "mol2", keep="vec_id long"), "mol2", "value", "vec_id long", clean=False), 4)


@query(placed_sql(3))
def a14_pdb_round_trip(spark, sf_dir):
    return placed(parse_column(format_column(drawn(spark, sf_dir), "pdb", keep="vec_id long"), "pdb", "value", "vec_id long", clean=False), 3)


@query(WITH + " SELECT vec_id, src, dst FROM bonds")
def i2_conect_bonds(spark, sf_dir):
    """Bonds read back from connection records."""
    got = parse_column(format_column(drawn(spark, sf_dir), "pdb", keep="vec_id long"), "pdb", "value", "vec_id long", clean=False)
    return got.select("vec_id", F.explode("mol.bonds").alias("b")).select("vec_id", F.least("b.src", "b.dst").alias("src"), F.greatest("b.src", "b.dst").alias("dst"))


@query(WITH + " SELECT vec_id, 1 AS residues, 21 AS sites, 'A' AS chain, vec_id % 1000 AS res_seq FROM embeddings")
def a15_pdb_model(spark, sf_dir):
    """The hierarchy of a coordinate file: residues, sites, chain."""
    def kernel(row):
        for _, lines in P.models(row["value"]):
            m = P.read_model(lines)
            yield {"vec_id": row["vec_id"], "residues": len(m["residues"]), "sites": sum(len(a["sites"]) for a in m["atoms"]), "chain": m["chains"][0]["id"], "res_seq": m["residues"][0]["id"][1]}

    return map_rows(format_column(drawn(spark, sf_dir), "pdb", keep="vec_id long"), kernel, "vec_id long, residues int, sites int, chain string, res_seq long")


@query("SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def a10_sdf_items(spark, sf_dir):
    """Suppliers written as data items and read back by the reader's own function."""
    def kernel(row):
        found = sdf.data_items(row["text"].splitlines())
        yield {"s_suppkey": row["s_suppkey"], "name": found.get("NAME"), "nation": found.get("NATION")}

    text = table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("> 12 <NAME> (x)\n%s\n\n>  <NATION>\n%s\n\n$$$$\n", "s_name", F.col("s_nationkey").cast("string")).alias("text"))
    return map_rows(text, kernel, "s_suppkey long, name string, nation string")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'no' ELSE 'yes' END AS flag, lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS code, printf('%.2f', s_acctbal) AS amount, CASE WHEN s_nationkey = 0 THEN '?' ELSE CAST(s_nationkey AS VARCHAR) END AS maybe FROM supplier""")
def b7_format_scalars(spark, sf_dir):
    """Flags, zero-padded whole numbers, fixed decimals and what is missing, as dictionary files spell them, by the writer's own function."""
    def kernel(row):
        amount, code = float(row["s_acctbal"]), int(row["s_nationkey"])
        yield {"s_suppkey": row["s_suppkey"], "flag": cif.format_value(amount >= 0), "code": cif.format_value(code, width=4), "amount": cif.format_value(amount, precision=2), "maybe": cif.format_value(code or None)}

    return map_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), kernel, "s_suppkey long, flag string, code string, amount string, maybe string")


def nation_text(spark, sf_dir):
    """A dictionary file for each region, its nations as a loop."""
    n = table(spark, sf_dir, "nation")
    quoted = F.when(F.col("n_name").rlike(r"\s"), F.concat(F.lit("'"), "n_name", F.lit("'"))).otherwise(F.col("n_name"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%02d %s", F.col("n_nationkey"), quoted))), "\n").alias("rows"))
    return rows.select("n_regionkey", F.concat(F.lit("data_r"), F.col("n_regionkey").cast("string"), F.lit("\nloop_\n_nation.key\n_nation.name\n"), "rows", F.lit("\n_region.key "), F.col("n_regionkey").cast("string"), F.lit("\n_region.note ?\n")).alias("value"))


@query("SELECT 'r' || n_regionkey AS block, CAST(n_nationkey AS INT) AS key, n_name AS name FROM nation")
def a16_cif_loops(spark, sf_dir):
    long = C.long_rows(nation_text(spark, sf_dir))
    return C.category(long, "_nation", ["key", "name"]).select("block", F.col("key").cast("int").alias("key"), "name")


@query("SELECT 'r' || n_regionkey AS block, '_nation' AS category, CAST(count(*) AS INT) AS n FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT 'r' || n_regionkey, '_region', 1 FROM nation")
def a17_ddl2_dict(spark, sf_dir):
    return C.as_dict(C.long_rows(nation_text(spark, sf_dir))).select("block", "category", F.size("rows").alias("n"))


@query("SELECT DISTINCT 'r' || n_regionkey AS block, '' AS frame, '_nation.key' AS key, 0 AS table_idx FROM nation")
def a18_prefix_search(spark, sf_dir):
    return C.prefix_search_first(C.long_rows(nation_text(spark, sf_dir)), "_nat")


@query(r"""SELECT p_partkey, CASE WHEN v = '' THEN '''''' WHEN v IN ('?', '.') OR regexp_matches(v, '\s') OR regexp_full_match(v, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?(\(\d+\))?') OR regexp_matches(v, '^[_#$''"\[\];]') THEN '''' || v || '''' ELSE v END AS quoted
 FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '_' || p_brand ELSE replace(p_type, ' ', '-') END AS v FROM part)""")
def b6_quote_values(spark, sf_dir):
    """Values with the quotes that a dictionary file needs, by the writer's own function."""
    def kernel(row):
        yield {"p_partkey": row["p_partkey"], "quoted": cif.quote(row["v"])}

    v = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.col("p_size").cast("string")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("_"), "p_brand")).otherwise(F.replace("p_type", F.lit(" "), F.lit("-")))
    return map_rows(table(spark, sf_dir, "part").select("p_partkey", v.alias("v")), kernel, "p_partkey long, quoted string")


RINGS = WITH + """, cut AS (WITH RECURSIVE r(vec_id, s, d, u) AS (SELECT vec_id, src, dst, src FROM bonds UNION SELECT r.vec_id, r.s, r.d, e.dst FROM r JOIN both_ways e ON e.vec_id = r.vec_id AND e.src = r.u AND NOT (e.src = r.s AND e.dst = r.d) AND NOT (e.src = r.d AND e.dst = r.s)) SELECT DISTINCT vec_id, s, d FROM r WHERE u = d)"""


@query(RINGS + " SELECT vec_id, s AS src, d AS dst FROM cut")
def e5_ring_bonds(spark, sf_dir):
    """Bonds on rings, by the low-link kernel."""
    got = drawn(spark, sf_dir).select("vec_id", F.explode(F.filter("mol.bonds", lambda b: b["ring"])).alias("b"))
    return got.select("vec_id", "b.src", "b.dst")


def rings(spark, sf_dir, finder, schema, **options):
    def kernel(row):
        yield from finder(row["vec_id"], M.from_row(row["mol"]), **options)

    return map_rows(drawn(spark, sf_dir), kernel, schema)


@query(WITH + """, walk AS (WITH RECURSIVE w(vec_id, first, tip, path) AS (SELECT vec_id, src, dst, [src, dst] FROM both_ways WHERE dst > src
  UNION ALL SELECT w.vec_id, w.first, e.dst, list_append(w.path, e.dst) FROM w JOIN both_ways e ON e.vec_id = w.vec_id AND e.src = w.tip WHERE e.dst > w.first AND NOT list_contains(w.path, e.dst) AND len(w.path) < 6) SELECT * FROM w)
 SELECT w.vec_id, len(path) AS size, count(*) // 2 AS rings FROM walk w JOIN both_ways e ON e.vec_id = w.vec_id AND e.src = w.tip AND e.dst = w.first WHERE len(path) > 2 GROUP BY 1, 2""")
def e6_small_rings(spark, sf_dir):
    """Simple rings of up to six atoms, by size."""
    def find(vec_id, mol):
        sizes = Counter(len(r) for r in M.all_rings(mol, 6, most=10**9)[0])
        for size, n in sizes.items():
            yield {"vec_id": vec_id, "size": size, "rings": n}

    return rings(spark, sf_dir, find, "vec_id long, size long, rings long")


@query()
def e6_all_rings(spark, sf_dir):
    """Simple rings of any size, where no atom is in more than the usual limit of a hundred; whole tells whether that is so."""
    def find(vec_id, mol):
        found, whole = M.all_rings(mol)
        yield {"vec_id": vec_id, "whole": whole, "rings": len(found) if whole else None}

    return rings(spark, sf_dir, find, "vec_id long, whole boolean, rings long")


@query(WITH + """, parts AS (SELECT vec_id, count(*) AS m FROM bonds GROUP BY 1),
 reach AS (WITH RECURSIVE r(vec_id, a, b) AS (SELECT vec_id, atom_id, atom_id FROM conformers UNION SELECT r.vec_id, r.a, e.dst FROM r JOIN both_ways e ON e.vec_id = r.vec_id AND e.src = r.b) SELECT vec_id, a, min(b) AS label FROM r GROUP BY 1, 2)
 SELECT f.vec_id, coalesce(p.m, 0) - 21 + f.n AS basis FROM (SELECT vec_id, count(DISTINCT label) AS n FROM reach GROUP BY 1) f LEFT JOIN parts p USING (vec_id)""")
def e8_smallest_rings(spark, sf_dir):
    """The size of a minimum cycle basis, as the kernel finds it."""
    return rings(spark, sf_dir, lambda v, mol: [{"vec_id": v, "basis": len(M.smallest_rings(mol))}], "vec_id long, basis long")


@query()
def e7_relevant_rings(spark, sf_dir):
    return rings(spark, sf_dir, lambda v, mol: [{"vec_id": v, "size": len(r), "ring": r} for r in M.relevant_rings(mol)], "vec_id long, size int, ring array<int>")


@query(WITH + " SELECT vec_id, round(sum(sqrt(d2)), 5) AS total, round(max(d2), 5) AS widest, round(sum(d2 * src), 5) AS weighed FROM pairs GROUP BY 1")
def g7_embed_distances(spark, sf_dir):
    """Conformers rebuilt from their distances alone: sums over the pairs of the new coordinates."""
    def kernel(row):
        x = np.array([[a["x"], a["y"], a["z"]] for a in row["atoms"]])
        y = D.embed_distances(np.square(x[:, None] - x[None]).sum(2))
        i, j = np.triu_indices(len(y), 1)
        d2 = np.square(y[i] - y[j]).sum(1)
        yield {"vec_id": row["vec_id"], "total": round(float(np.sqrt(d2).sum()), 5), "widest": round(float(d2.max()), 5), "weighed": round(float((d2 * i).sum()), 5)}

    return map_rows(molecules(spark, sf_dir), kernel, "vec_id long, total double, widest double, weighed double")


@query(WITH + ", " + ELEMENTS + f""", s AS (SELECT vec_id, atom_id, 12 * x AS x, 12 * y AS y, 12 * z AS z, rvdw + 1.4 AS r FROM atoms JOIN el ON el.num = elem),
 l AS (SELECT sqrt(1 - z * z) * cos(i * {G.TURN!r}) AS px, sqrt(1 - z * z) * sin(i * {G.TURN!r}) AS py, z AS pz FROM (SELECT i, {1 - 1 / 92!r}::DOUBLE - i * {2 / 92!r}::DOUBLE AS z FROM range(92) t(i)))
 SELECT s.vec_id, s.atom_id, round({4 * math.pi!r} * any_value(s.r) * any_value(s.r) * count(*) FILTER (NOT EXISTS (SELECT 1 FROM s o WHERE o.vec_id = s.vec_id AND o.atom_id <> s.atom_id AND (s.x + s.r * px - o.x) * (s.x + s.r * px - o.x) + (s.y + s.r * py - o.y) * (s.y + s.r * py - o.y) + (s.z + s.r * pz - o.z) * (s.z + s.r * pz - o.z) <= o.r * o.r)) / 92, 4) AS area FROM s, l GROUP BY 1, 2""")
def l3_surface_area(spark, sf_dir):
    """Surface area of the atoms, by the kernel."""
    def kernel(row):
        x = 12 * np.array([[a["x"], a["y"], a["z"]] for a in row["atoms"]])
        r = np.array([periodic_table()[CYCLE[(i + row["vec_id"]) % 5]].vdw_radius for i in range(len(x))])
        for i, area in enumerate(D.surface_area(x, r)):
            yield {"vec_id": row["vec_id"], "atom_id": i, "area": round(float(area), 4)}

    return map_rows(spread(molecules(spark, sf_dir)), kernel, "vec_id long, atom_id int, area double")


def next_pairs(spark, sf_dir):
    """Each conformer with the next one."""
    own = molecules(spark, sf_dir)
    return spread(own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("atoms").alias("other")), "vec_id"), 1 << 18)


def arrays(row):
    return [np.array([[a["x"], a["y"], a["z"]] for a in row[c]]) for c in ("atoms", "other")]


#: Kabsch's least deviation of each conformer from the next one, by the singular values of their covariance in closed form.
LEAST = WITH + """, duo AS (SELECT a.vec_id, a.x AS x, a.y AS y, a.z AS z, b.x AS u, b.y AS v, b.z AS w FROM conformers a JOIN conformers b ON b.vec_id = a.vec_id + 1 AND b.atom_id = a.atom_id),
mid AS (SELECT *, avg(x) OVER p AS mx, avg(y) OVER p AS my, avg(z) OVER p AS mz, avg(u) OVER p AS mu, avg(v) OVER p AS mv, avg(w) OVER p AS mw FROM duo WINDOW p AS (PARTITION BY vec_id)),
cov AS (SELECT vec_id, count(*) AS n, sum((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz) + (u - mu) * (u - mu) + (v - mv) * (v - mv) + (w - mw) * (w - mw)) AS g,
 sum((x - mx) * (u - mu)) AS a, sum((x - mx) * (v - mv)) AS b, sum((x - mx) * (w - mw)) AS c, sum((y - my) * (u - mu)) AS d, sum((y - my) * (v - mv)) AS e, sum((y - my) * (w - mw)) AS f, sum((z - mz) * (u - mu)) AS h, sum((z - mz) * (v - mv)) AS i, sum((z - mz) * (w - mw)) AS j FROM mid GROUP BY 1),
sq AS (SELECT *, a * (e * j - f * i) - b * (d * j - f * h) + c * (d * i - e * h) AS det, a * a + d * d + h * h AS p, b * b + e * e + i * i AS q, c * c + f * f + j * j AS r, a * b + d * e + h * i AS s, a * c + d * f + h * j AS t, b * c + e * f + i * j AS k FROM cov),
eig AS (SELECT *, (p + q + r) / 3 AS m, sqrt(((p - (p + q + r) / 3) ** 2 + (q - (p + q + r) / 3) ** 2 + (r - (p + q + r) / 3) ** 2 + 2 * (s * s + t * t + k * k)) / 6) AS o FROM sq),
ang AS (SELECT *, acos(greatest(-1, least(1, ((p - m) * ((q - m) * (r - m) - k * k) - s * (s * (r - m) - k * t) + t * (s * k - (q - m) * t)) / (2 * o * o * o)))) / 3 AS phi FROM eig),
least_ AS (SELECT vec_id, round(sqrt(greatest(0, g - 2 * (sqrt(greatest(0, m + 2 * o * cos(phi))) + sqrt(greatest(0, m + 2 * o * cos(phi + 4 * pi() / 3))) + sign(det) * sqrt(greatest(0, m + 2 * o * cos(phi + 2 * pi() / 3))))) / n), 5) AS rmsd FROM ang)"""


@query(LEAST + " SELECT vec_id, rmsd, rmsd AS moved FROM least_")
def l1_superpose(spark, sf_dir):
    """The least deviation of each conformer from the next one, as told, and as measured after the turn."""
    def kernel(row):
        q, t = arrays(row)
        m, rmsd = D.superpose(q, t)
        yield {"vec_id": row["vec_id"], "rmsd": round(rmsd, 5) + 0.0, "moved": round(float(np.sqrt(np.square(D.move(m, q) - t).sum(1).mean())), 5) + 0.0}

    return map_rows(next_pairs(spark, sf_dir), kernel, "vec_id long, rmsd double, moved double")


@query()
def l4_trimmed_superpose(spark, sf_dir):
    def kernel(row):
        q, t = arrays(row)
        _, keep, rmsd = D.trimmed_superpose(12 * q, 12 * t)
        yield {"vec_id": row["vec_id"], "kept": len(keep), "rmsd": round(rmsd, 6)}

    return map_rows(next_pairs(spark, sf_dir), kernel, "vec_id long, kept int, rmsd double")


@query()
def l6_tm_score(spark, sf_dir):
    def kernel(row):
        q, t = arrays(row)
        yield {"vec_id": row["vec_id"], "score": round(D.tm_score(25 * q, 25 * t)[0], 6)}

    return map_rows(next_pairs(spark, sf_dir), kernel, "vec_id long, score double")


@query()
def l6_align_chains(spark, sf_dir):
    def kernel(row):
        q, t = arrays(row)
        found = align_chains(25 * q, 25 * t)
        yield {"vec_id": row["vec_id"], "pairs": len(found.pairs), "score": round(found.score()[1], 6)}

    return map_rows(next_pairs(spark, sf_dir), kernel, "vec_id long, pairs int, score double")


@query()
def l7_align_shapes(spark, sf_dir):
    """Rigid alignment of each conformer to the next one by shared volume."""
    def kernel(row):
        q, t = arrays(row)
        qk, tk = ([CYCLE[(i + v) % 5] for i in range(21)] for v in (row["vec_id"], row["vec_id"] + 1))
        r = [np.array([0.8 * periodic_table()[z].vdw_radius for z in k]) for k in (qk, tk)]
        yield {"vec_id": row["vec_id"], "score": round(X.align_shapes(12 * q, r[0], qk, 12 * t, r[1], tk, seed=row["vec_id"])[1], 4)}

    return map_rows(next_pairs(spark, sf_dir), kernel, "vec_id long, score double")


@query()
def f8_guess_bonds(spark, sf_dir):
    """Bonds from coordinates, with as many to an atom as its element takes."""
    def kernel(row):
        mol = M.from_row(row["mol"])
        bare = M.Molecule()
        for a in mol.atoms:
            bare.add_atom(M.Atom(a.z))
        bare.confs = mol.confs
        for b in X.guess_connectivity(bare, slack=0.1).bonds:
            yield {"vec_id": row["vec_id"], "src": b.src, "dst": b.dst}

    return map_rows(drawn(spark, sf_dir), kernel, "vec_id long, src int, dst int")


@query(f"WITH facts(i, atoms, bonds, hydrogens, rings, aromatic, charge) AS (VALUES {FACTS}) SELECT n_nationkey AS key, bonds, bonds AS found FROM nation JOIN facts ON i = n_nationkey % 20")
def f13_coordinates(spark, sf_dir):
    """Coordinates made from the bonds of a line, and how many of the bonds (without hydrogens) are found again from these (F9, F10, F13)."""
    def kernel(row):
        mol = M.from_row(row["mol"])
        found = set()
        if X.generate_coords(mol):
            bare = M.Molecule()
            for a in mol.atoms:
                bare.add_atom(M.Atom(a.z))
            bare.confs = mol.confs
            X.guess_everything(bare, slack=0.3)
            found = {(min(b.src, b.dst), max(b.src, b.dst)) for b in bare.bonds}
        yield {"key": row["key"], "bonds": len(mol.bonds), "found": len(found & {(min(b.src, b.dst), max(b.src, b.dst)) for b in mol.bonds}) if len(found) == len(mol.bonds) else None}

    known = F.array(*(F.lit(r[0]) for r in CORPUS))
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.get(known, (F.col("n_nationkey") % 20).cast("int")).alias("line"))
    return map_rows(parse_column(own, "smi", "line", "key long").select("key", "mol"), kernel, "key long, bonds int, found int")


@query(f"WITH {LINES} SELECT key, atoms + hydrogens AS shown, hydrogens AS hidden FROM lines")
def f6_hydrogens(spark, sf_dir):
    """Implicit hydrogens made atoms, and atoms made implicit again (F6, F7)."""
    def kernel(row):
        full = M.reveal_hydrogens(M.from_row(row["mol"]))
        shown = len(full.atoms)
        yield {"key": row["key"], "shown": shown, "hidden": sum(a.impl_h for a in M.hide_hydrogens(full).atoms)}

    return map_rows(parse_column(corpus(spark, sf_dir), "smi", "line", "key long"), kernel, "key long, shown int, hidden int")


TURNED = 37.0


@query(WITH + f""", axis AS (SELECT a.vec_id, b.x AS px, b.y AS py, b.z AS pz, (b.x - a.x) / l AS ux, (b.y - a.y) / l AS uy, (b.z - a.z) / l AS uz FROM (SELECT a.vec_id, sqrt({'(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2'}) AS l FROM conformers a JOIN conformers b USING (vec_id) WHERE a.atom_id = 9 AND b.atom_id = 10) n JOIN conformers a USING (vec_id) JOIN conformers b USING (vec_id) WHERE a.atom_id = 9 AND b.atom_id = 10),
 v AS (SELECT c.vec_id, c.atom_id, px, py, pz, ux, uy, uz, c.x - px AS x, c.y - py AS y, c.z - pz AS z, ux * (c.x - px) + uy * (c.y - py) + uz * (c.z - pz) AS d, CASE WHEN atom_id > 10 THEN radians({TURNED}::DOUBLE) ELSE 0 END AS t FROM conformers c JOIN axis USING (vec_id))
 SELECT vec_id, atom_id, round(px + x * cos(t) + (uy * z - uz * y) * sin(t) + ux * d * (1 - cos(t)), 5) AS x, round(py + y * cos(t) + (uz * x - ux * z) * sin(t) + uy * d * (1 - cos(t)), 5) AS y, round(pz + z * cos(t) + (ux * y - uy * x) * sin(t) + uz * d * (1 - cos(t)), 5) AS z FROM v""")
def g6_rotate_bonds(spark, sf_dir):
    """Conformers as chains, their second half turned by an angle around the bond in the middle."""
    def kernel(row):
        mol = M.Molecule()
        for i in range(len(row["atoms"])):
            mol.add_atom(M.Atom(6))
        for i in range(len(row["atoms"]) - 1):
            mol.add_bond(i, i + 1)
        x = np.array([[a["x"], a["y"], a["z"]] for a in row["atoms"]])
        for i, p in enumerate(D.rotate_bond(mol.finish(), x, 9, 10, TURNED)):
            yield {"vec_id": row["vec_id"], "atom_id": i, **{c: round(float(v), 5) + 0.0 for c, v in zip("xyz", p, strict=True)}}

    return map_rows(molecules(spark, sf_dir), kernel, "vec_id long, atom_id int, x double, y double, z double")


def valley(a: float):
    """A curved valley with its end at (a, a^2)."""
    def f(p):
        x, y = p
        return float((a - x) ** 2 + 100 * (y - x * x) ** 2), np.array([-2 * (a - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    return f


def ends(spark, sf_dir, minimise, digits=4):
    """Where a minimiser ends in the valley of each conformer's first coordinate."""
    def kernel(row):
        x, y = minimise(5 * row["atoms"][0]["x"])
        yield {"vec_id": row["vec_id"], "x": round(float(x), digits) + 0.0, "y": round(float(y), digits) + 0.0}

    return map_rows(spread(molecules(spark, sf_dir), 1 << 18), kernel, "vec_id long, x double, y double")


@query(WITH + " SELECT vec_id, round(least(5 * x, 0.25), 4) AS x, round(least(5 * x, 0.25) ** 2, 4) AS y FROM points")
def m1_minimise(spark, sf_dir):
    """The end of a curved valley, by the quasi-Newton minimiser; a bound keeps it from many of them."""
    return ends(spark, sf_dir, lambda a: l_bfgs_b(valley(a), np.array([-1.2, 1.0]), (None, np.array([0.25, np.inf])), tolerance=1e-9, steps=2000).x)


@query(placed_sql(3))
def a19_mmcif_round_trip(spark, sf_dir):
    """Conformers written as loops of atom sites and read as molecules; the text is made by built-in expressions."""
    keys = ("group_PDB", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z")
    symbols = F.create_map(*(F.lit(v) for z in CYCLE for v in (z, periodic_table()[z].symbol)))
    line = F.transform("atoms", lambda a, i: F.format_string("ATOM %s A%d LIG A 1 %.3f %.3f %.3f", symbols[F.array(*map(F.lit, CYCLE))[((i + F.col("vec_id")) % 5).cast("int")]], i, 12 * a["x"], 12 * a["y"], 12 * a["z"]))
    text = molecules(spark, sf_dir).select("vec_id", F.concat(F.lit("data_m\nloop_\n" + "".join(f"_atom_site.{k}\n" for k in keys)), F.array_join(line, "\n")).alias("value"))
    return placed(parse_column(text, "cif", "value", "vec_id long", clean=False), 3)


@query("SELECT 'r' || n_regionkey AS block, CAST(n_nationkey AS INT) AS key, n_name AS name FROM nation")
def b5_write_cif(spark, sf_dir):
    """Files parsed, written aligned, and parsed again."""
    def kernel(row):
        for block in cif.read_blocks(row["value"]):
            yield {"value": cif.write(block, align=True)}

    again = map_rows(nation_text(spark, sf_dir).select("value"), kernel, "value string")
    return C.category(C.long_rows(again), "_nation", ["key", "name"]).select("block", F.col("key").cast("int").alias("key"), "name")


@query(LEAST + " SELECT vec_id, rmsd FROM least_")
def l2_rmsd(spark, sf_dir):
    """The deviation of a conformer, moved as a rigid body, from the next one is the least one of the two."""
    def kernel(row):
        x, other = arrays(row)
        t = row["vec_id"] / 7
        y = x @ np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]]) + [1, 2, 3]
        yield {"vec_id": row["vec_id"], "rmsd": round(D.superpose(y, other)[1], 5) + 0.0}

    return map_rows(next_pairs(spark, sf_dir), kernel, "vec_id long, rmsd double")


@query(WITH + """, mid AS (SELECT vec_id, x - avg(x) OVER p AS x, y - avg(y) OVER p AS y, z - avg(z) OVER p AS z FROM conformers WINDOW p AS (PARTITION BY vec_id)),
 cov AS (SELECT vec_id, sum(x * x) AS p, sum(y * y) AS q, sum(z * z) AS r, sum(x * y) AS s, sum(x * z) AS t, sum(y * z) AS k FROM mid GROUP BY 1),
 eig AS (SELECT *, (p + q + r) / 3 AS m, sqrt(((p - (p + q + r) / 3) ** 2 + (q - (p + q + r) / 3) ** 2 + (r - (p + q + r) / 3) ** 2 + 2 * (s * s + t * t + k * k)) / 6) AS o FROM cov)
 SELECT vec_id, round(m + 2 * o * cos(acos(greatest(-1, least(1, ((p - m) * ((q - m) * (r - m) - k * k) - s * (s * (r - m) - k * t) + t * (s * k - (q - m) * t)) / (2 * o * o * o)))) / 3 + 2 * pi() / 3), 6) AS off FROM eig""")
def g4_fit_plane(spark, sf_dir):
    """Squared distances of a conformer's atoms from its plane: the least eigenvalue of their scatter."""
    def kernel(row):
        x = np.array([[a["x"], a["y"], a["z"]] for a in row["atoms"]])
        p = D.fit_plane(x)
        yield {"vec_id": row["vec_id"], "off": round(float(np.square(x @ p[:3] + p[3]).sum()), 6) + 0.0}

    return map_rows(molecules(spark, sf_dir), kernel, "vec_id long, off double")


VALLEY = WITH + " SELECT vec_id, round(5 * x, {d}) AS x, round(25 * x * x, {d}) AS y FROM points"


@query(VALLEY.replace("{d}", "4"))
def m2_minimise_bfgs(spark, sf_dir):
    return ends(spark, sf_dir, lambda a: bfgs(valley(a), np.array([-1.2, 1.0]), tolerance=1e-9, steps=2000).x)


@query(VALLEY.replace("{d}", "3"))
def m3_minimise_simplex(spark, sf_dir):
    return ends(spark, sf_dir, lambda a: nelder_mead(lambda p: valley(a)(p)[0], np.array([-1.2, 1.0]), tolerance=1e-18).x, 3)
