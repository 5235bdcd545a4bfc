import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from molecast.functions import substructures as S
from molecast.functions.smiles import read_smiles, write_smiles
from molecast.operators import spatial
from molecast.operators.components import components
from molecast.operators.geometry import fibonacci_lattice
from molecast.operators.graph import erase_nodes, match_pattern, unique_edges
from molecast.operators.spatial import SpatialIndex, distance_join, knn_join, neighbour_lists, self_join
from molecast.sources.mmcif import as_dict, category, long_rows
from molecast.sources.molecules import conceal_hydrogens, format_column, parse_column, read_molecules, register_reader, write_molecules


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(0).uniform(-1, 1, (300, 3))
    x[5] = x[6]
    return x, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")


def test_range_joins(cloud):
    x, df = cloud
    d2 = np.square(x[:, None] - x[None]).sum(2)
    for c in (0.11, 0.4, 5.0):
        want = {(i, j) for i, j in zip(*np.nonzero(d2 <= c * c), strict=True)}
        for side in ("query", "points"):
            got = [(r.q, r.p) for r in distance_join(df, df, c, copy=side).collect()]
            assert len(got) == len(set(got)) and set(got) == want
        pairs = [(r.a, r.b) for r in self_join(df, c).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i, j in want if i < j}
    lists = {r.q: r.neighbours for r in neighbour_lists(df.filter("id < 20"), df.filter("id >= 250"), 0.11).collect()}
    assert lists == {i: [j for j in range(250, 300) if d2[i, j] <= 0.11**2] for i in range(20)}
    with pytest.raises(ValueError):
        distance_join(df, df, 0)


@pytest.mark.parametrize(("k", "cutoff"), [(1, None), (4, None), (400, None), (3, 0.2)])
def test_nearest(cloud, k, cutoff):
    x, df = cloud
    d2 = np.square(x[:60, None] - x[None]).sum(2)
    got = defaultdict(list)
    for r in knn_join(df.filter("id < 60"), df, k, cutoff).orderBy("q", "place").collect():
        got[r.q].append(r.p)
    for i in range(60):
        want = sorted(range(300), key=lambda j: (d2[i, j], j))[:k]
        assert got[i] == [j for j in want if cutoff is None or d2[i, j] <= cutoff**2]


def test_nearest_within_a_wide_cutoff(spark, monkeypatch):
    """Dense points are looked at within as much space as k needs, not within the cutoff; results are those of all pairs."""
    met = []

    def spy(pairs, k, rank=spatial._nearest):
        met.append(pairs.count())
        return rank(pairs, k)

    monkeypatch.setattr(spatial, "_nearest", spy)
    x = np.round(np.random.default_rng(1).uniform(0, 1, (600, 3)), 3)
    x[:20], x[599] = x[20], 5.0
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    d2 = np.square(x[:, None] - x[None]).sum(2)
    for cutoff in (0.9, 0.1):
        got = defaultdict(list)
        for r in knn_join(df, df, 4, cutoff).orderBy("q", "place").collect():
            got[r.q].append(r.p)
        for i in range(600):
            assert got[i] == [j for j in sorted(range(600), key=lambda j: (d2[i, j], j))[:4] if d2[i, j] <= cutoff**2]
    assert max(met) < 600 * 60
    with pytest.raises(ValueError):
        knn_join(df, df, 4, 0.0)


def test_nearest_of_far_queries_and_nothing(spark, cloud):
    _, df = cloud
    far = spark.createDataFrame([(0, 50.0, 0.0, 0.0)], df.schema)
    assert len(knn_join(far, df, 3).collect()) == 3
    assert knn_join(df, df.limit(0), 3).collect() == [] and knn_join(df, df, 0).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, {a}), label.setdefault(b, {b})
            if label[a] is not label[b]:
                joined = label[a] | label[b]
                for v in joined:
                    label[v] = joined
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(s) for v, s in label.items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_patterns_on_a_petersen_graph(spark):
    edges = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    df = unique_edges(spark.createDataFrame([(1, a, b) for a, b in [*edges, (1, 0)]], "vec_id long, src int, dst int"))
    nodes = spark.createDataFrame([(1, i, i % 2) for i in range(10)], "vec_id long, atom_id int, elem int")
    ring = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]
    assert match_pattern(df, ring).count() == 120
    assert match_pattern(df, [(0, 1), (1, 2), (0, 2)]).count() == 0  # no triangles
    assert match_pattern(df, [(0, 1), (1, 2)]).count() == 60 == match_pattern(df, [(0, 1), (1, 2)], "induced").count()
    assert match_pattern(df, [(0, 1), (1, 2)], "graph", nodes).count() == 0
    assert match_pattern(df, [(0, 1)], nodes=nodes, labels={0: 0, 1: 1}).count() == sum((a + b) % 2 for a, b in edges)
    kept, left = erase_nodes(nodes, df, F.col("atom_id") < 5)
    assert kept.count() == 5 and {(r.src, r.dst) for r in left.collect()} <= {(i, j) for i in range(5) for j in range(5)} and left.count() == 5


def test_lattice(spark):
    p = np.array([[r.x, r.y, r.z] for r in fibonacci_lattice(spark, 50).collect()])
    assert np.allclose(np.linalg.norm(p, axis=1), 1) and abs(p.mean(0)).max() < 0.03


LINES = ["CCO ethanol", "c1ccccc1 benzene", "C[N+](C)(C)C choline", "CC(=O)[O-] acetate"]


@pytest.mark.parametrize("fmt", ["smi", "sdf", "mol2", "pdb"])
def test_files_round_trip(spark, tmp_path, fmt):
    mols = parse_column(spark.createDataFrame([(x,) for x in LINES], "line string"), "smi", "line")
    if fmt == "pdb":  # needs coordinates
        mols = mols.withColumn("mol", F.col("mol").withField("confs", F.array(F.flatten(F.transform("mol.atoms", lambda a: F.array(a["id"].cast("double"), F.lit(0.0), F.lit(0.0)))))))
        texts = format_column(mols, "pdb").collect()
        for i, r in enumerate(texts):
            (tmp_path / f"{i}.pdb").write_text(r.value)
        path = str(tmp_path)
    else:
        path = str(tmp_path / "out")
        write_molecules(mols, path, fmt)
    got = read_molecules(spark, path, fmt).select("mol.name", F.size("mol.atoms").alias("n"), F.size("mol.bonds").alias("m"), "mol.error").collect()
    assert sorted((r.n, r.m) for r in got) == [(3, 2), (4, 3), (5, 4), (6, 6)] and all(r.error is None for r in got)
    if fmt != "pdb":
        assert sorted(r.name for r in got) == ["acetate", "benzene", "choline", "ethanol"]


def test_modes_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("CC",), ("C(",), ("C(C)(C)(C)(C)C",), (None,)], "line string")
    assert [r.mol.error is None for r in parse_column(df, "smi", "line").collect()] == [True, False, False]
    assert parse_column(df, "smi", "line", mode="DROPMALFORMED").count() == 1
    assert parse_column(df, "smi", "line", clean=False, mode="DROPMALFORMED").count() == 2
    with pytest.raises(PythonException, match="SmilesError|ValueError"):
        parse_column(df, "smi", "line", mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        parse_column(df, "smi", "line", mode="OTHER")
    with pytest.raises(ValueError):
        read_molecules(spark, "x.unknown")
    register_reader(["chain"], "\n", lambda t: (read_smiles("C" * int(t)) for _ in (1,)))
    assert parse_column(spark.createDataFrame([("4",)], "n string"), "chain", "n").select(F.size("mol.atoms")).first()[0] == 4


def test_stream_equals_batch(spark, tmp_path):
    for i, x in enumerate(LINES):
        (tmp_path / f"{i}.smi").write_text(x + "\n")
    query = read_molecules(spark, str(tmp_path), "smi", stream=True).select("mol.name", F.size("mol.atoms").alias("n")).writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.sql("SELECT * FROM streamed").collect()) == sorted(read_molecules(spark, str(tmp_path), "smi").select("mol.name", F.size("mol.atoms").alias("n")).collect())


def test_hydrogens_are_concealed(spark):
    got = conceal_hydrogens(parse_column(spark.createDataFrame([("[H]C([H])([H])O[H]",)], "line string"), "smi", "line")).first().mol
    assert [a.impl_h for a in got.atoms] == [3, 1]


CIF = """data_t
_cell.a 1
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.pdbx_PDB_model_num
ATOM N N . ALA A 1 0 0 0 1 1
ATOM C CA A ALA A 1 1.5 0 0 0.4 1
ATOM C CA B ALA A 1 1.6 0 0 0.6 1
ATOM S SG . CYS B 2 9 0 0 1 1
ATOM S SG . CYS B 3 9 2 0 1 1
ATOM N N . ALA A 1 0 0 0 1 2
loop_
_struct_conn.conn_type_id
_struct_conn.ptnr1_label_asym_id
_struct_conn.ptnr1_label_seq_id
_struct_conn.ptnr1_label_atom_id
_struct_conn.ptnr2_label_asym_id
_struct_conn.ptnr2_label_seq_id
_struct_conn.ptnr2_label_atom_id
_struct_conn.pdbx_value_order
disulf B 2 SG B 3 SG doub
hydrog A 1 N A 1 CA ?
"""


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "t.cif").write_text(CIF)
    mols = {r.mol.props["model"]: r.mol for r in read_molecules(spark, str(tmp_path / "t.cif")).collect()}
    assert sorted(mols) == ["1", "2"] and len(mols["1"].atoms) == 4 and [(b.src, b.dst, b.bo) for b in mols["1"].bonds] == [(2, 3, 2)]
    assert len(mols["1"].confs) == 2 and mols["1"].confs[0][3] == 1.5 and [s.name for s in mols["1"].subs] == ["ALA", "CYS", "CYS", "A", "B"]
    long = long_rows(spark.createDataFrame([(CIF,)], "value string"))
    sites = category(long, "_atom_site", ["type_symbol", "label_alt_id"])
    assert sites.count() == 6 and sites.filter("label_alt_id IS NULL").count() == 4
    assert {r.category: len(r.rows) for r in as_dict(long).collect()} == {"_cell": 1, "_atom_site": 6, "_struct_conn": 2}


def test_written_lines_are_read_back():
    for x in LINES:
        assert write_smiles(read_smiles(write_smiles(read_smiles(x)))) == write_smiles(read_smiles(x))


def test_sql_functions(spark):
    from molecast.functions.sql import register

    register(spark)
    r = spark.sql("SELECT smiles_summary('c1ccccc1O phenol') AS s, smiles_rewrite('OCC') AS w, smiles_rewrite('C(') AS bad, smiles_charges('CC') AS q, sphere_areas(array(0D, 0D, 0D), array(1D)) AS a").first()
    assert (r.s.name, r.s.heavy_atoms, r.s.rings, r.s.hydrogens, r.s.error) == ("phenol", 7, 1, 6, None) and r.s.weight == pytest.approx(94.11, abs=0.01)
    assert r.w == "OCC" and r.bad is None and len(r.q) == 2 and r.a[0] == pytest.approx(4 * np.pi * 2.4**2)
    assert spark.sql("SELECT count(*) FROM smiles_rings('C12C3C4C1C5C2C3C45', true)").first()[0] == 24
    rows = spark.sql("SELECT t.key, t.value FROM VALUES ('data_a\n_x.y 1') v(text), LATERAL cif_rows(v.text) t").collect()
    assert [tuple(r) for r in rows] == [("_x.y", "1")]


def test_stream_to_files(spark, tmp_path):
    from molecast.streaming.molecules import stream_molecules, write_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.smi").write_text("CCO ethanol\nc1ccccc1 benzene\n")
    write_stream(stream_molecules(spark, str(tmp_path / "in"), "smi"), str(tmp_path / "out"), str(tmp_path / "log"), "sdf").awaitTermination()
    assert sorted(r.mol.name for r in read_molecules(spark, str(tmp_path / "out"), "sdf").collect()) == ["benzene", "ethanol"]


def test_cut_and_purge(spark):
    from molecast.plans.lineage import cut, purge

    df = cut(spark.range(5), "five")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert purge(spark) and not purge(spark)


def test_substructures(spark):
    text = spark.createDataFrame([("CC(=O)Nc1ccccc1 anilide",)], "line string")
    df = parse_column(text, "smi", "line").select("mol")
    ids = lambda *x: F.array(*map(F.lit, x))
    mol = S.append(S.append(F.col("mol"), S.new(ids(0, 1, 2), "acyl", 1, 2)), S.new(ids(4, 5, 6, 7, 8, 9), "ring", 2, 3))
    held = df.select(mol.alias("mol"))
    m = F.col("mol")
    got = held.select(
        F.size(S.atoms(m, 0)).alias("atoms"), S.bonds(m, 0)["id"].alias("bonds"), S.contains(m, 0, 2).alias("has"), S.contains(m, 1, 2).alias("hasnt"), S.contains_bond(m, 0, 1).alias("bond"), S.holders(m, 5).alias("holders"), S.own_ids(m, 1, F.lit(6)).alias("own"), S.own_ids(m, 1, F.lit(0)).alias("none"),
        F.size(S.by_category(m, 3)).alias("category"), S.by_name(m, "acyl")[0]["id"].alias("name"), S.substructure(m, 7).alias("nothing"),
    ).first()
    assert (got.atoms, got.bonds, got.has, got.hasnt, got.bond, got.holders, got.own, got.none, got.category, got.name, got.nothing) == (3, [0, 1], True, False, True, [1], 2, None, 1, 1, None)

    def after(change):
        return [(s["name"], s["id"], s["category"], s["atom_ids"]) for s in held.select(change["subs"].alias("s")).first().s]

    acyl, ring = ("acyl", 1, 2, [0, 1, 2]), ("ring", 2, 3, [4, 5, 6, 7, 8, 9])
    assert after(S.add_atoms(m, 0, ids(2, 3, 3, 99))) == [("acyl", 1, 2, [0, 1, 2, 3]), ring]
    assert after(S.add_bonds(m, 0, ids(2))) == [("acyl", 1, 2, [0, 1, 2, 3]), ring]
    assert after(S.erase_atoms(m, 1, ids(4, 9, 0))) == [acyl, ("ring", 2, 3, [5, 6, 7, 8])]
    assert after(S.clear_atoms(m, 0)) == [("acyl", 1, 2, []), ring]
    assert after(S.sorted_atoms(S.add_atoms(S.clear_atoms(m, 0), 0, ids(3, 1)), 0)) == [("acyl", 1, 2, [1, 3]), ring]
    assert after(S.with_field(m, 1, name="phenyl", category=7)) == [acyl, ("phenyl", 2, 7, ring[3])]
    assert after(S.remove(m, 0)) == [ring] and after(S.remove(m, 5)) == [acyl, ring] and after(S.clear(m)) == []
    extra = S.new(ids(3), "n")
    assert after(S.insert(m, 1, extra)) == [acyl, ("n", 0, 0, [3]), ring] and after(S.insert(m, 9, extra))[-1][0] == "n"
    with_conf = held.select(m.withField("confs", F.array(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: i.cast("double")))).alias("mol"))
    assert with_conf.select(S.coordinates(F.col("mol"), 0).alias("x")).first().x == [float(i) for i in range(9)]


def test_kept_index(spark, cloud):
    points, df = cloud
    index = SpatialIndex(spark, "kept_points", 0.5, buckets=4).rebuild(df)
    try:
        for cutoff in (0.5, 0.2):
            want = {(r.q, r.p) for r in distance_join(df, df, cutoff).collect()}
            assert {(r.q, r.p) for r in index.join(df, cutoff).collect()} == want
        with pytest.raises(ValueError):
            index.join(df, 0.6)
        plan = index.join(df.hint("shuffle_merge"))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan or "BroadcastHashJoin" in plan
        assert index.rebuild(df.limit(0)).join(df).collect() == []
    finally:
        index.drop()
    with pytest.raises(ValueError):
        SpatialIndex(spark, "none", 0)


def test_surfaces_within_rows_and_by_cubes(spark):
    """Small molecules in a row, large ones by cubes, and both at once give the areas of the kernel."""
    from molecast.functions.descriptors import surface_area as kernel
    from molecast.operators.geometry import surface_area

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for mol, n in enumerate((1, 2, 5, 40, 70)):
        x, r = rng.uniform(0, 6, (n, 3)), rng.uniform(1, 2, n)
        rows += [(mol, i, *map(float, x[i]), float(r[i])) for i in range(n)]
        want |= {(mol, i): v for i, v in enumerate(kernel(x, r - 1.4 + 1.4, 50, 0.0))}
    df = spark.createDataFrame(rows, "mol long, id int, x double, y double, z double, r double")
    for small in (256, 0, 10):
        got = {(r.mol, r.id): r.area for r in surface_area(df, 50, small=small).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want), small
    assert surface_area(df.limit(0), 50).collect() == []
