import math

import numpy as np
import pytest

from molecast.functions import cif, mol2, pdb, sdf
from molecast.functions import descriptors as D
from molecast.functions import molecule as M
from molecast.functions.coordinates import align_flexible, align_shapes, generate_coords, guess_connectivity, guess_everything, rotatable_bonds
from molecast.functions.chains import align_chains, best_path
from molecast.functions.elements import find_element, periodic_table
from molecast.functions.guess2d import guess_charges, guess_charges_and_hydrogens, guess_hydrogens
from molecast.functions.guess3d import guess_types
from molecast.functions.perception import localised_orders, sanitize
from molecast.functions.optimize import bfgs, l_bfgs, l_bfgs_b, nelder_mead
from molecast.functions.smiles import SmilesError, read_smiles, write_smiles

LINES = ["CC", "C#N", "CC(=O)[O-]", "c1ccccc1", "c1ccc2CCCc2c1", "C[C@@H](C(=O)O)N", "[Na+].[Cl-]", "F/C=C/F", "F/C=C\\F", "[13CH4]", "C%12CCCCC%12", "OS(=O)(=S)O", "c1cc[nH]c1", "c1ccsc1", "N[C@H](C)C(=O)O", "[N+](=O)([O-])c1ccccc1", "CCN(CC)C(=O)c1ccc(Cl)cc1Br", "O=C1CCCN1C", "C1CC1.C=C"]


@pytest.mark.parametrize("line", LINES)
def test_smiles_round_trip(line):
    a = read_smiles(line)
    assert sanitize(a) is None
    b = read_smiles(write_smiles(a))
    assert sanitize(b) is None
    for f in (lambda m: sorted((x.z, x.impl_h, x.fcharge, x.isotope, x.aromatic, x.hyb) for x in m.atoms), lambda m: sorted(x.bo for x in m.bonds), lambda m: [x.config for x in m.bonds if x.config], lambda m: m.num_sssr):
        assert f(a) == f(b)


@pytest.mark.parametrize("line", ["C-1CCCCC=1", "C12CCCCC12", "C11", "C(", "C)", "C1CC", "[Zz]", "C==C", "(C)", "[C", "C%1"])
def test_bad_smiles(line):
    with pytest.raises(SmilesError):
        read_smiles(line)


def test_chirality_parity():
    """The same centre written in different orders."""
    clock = {write_smiles(read_smiles(x)) for x in ("N[C@](C)(F)O", "N[C@@](F)(C)O")}
    assert len({read_smiles(x).atoms[1].chirality for x in ("N[C@](C)(F)O",)}) == 1 and len(clock) == 2
    a, b = read_smiles("N[C@@H](C)O"), read_smiles("N[C@H](C)O")
    assert a.atoms[1].chirality != b.atoms[1].chirality


def test_periodic_table():
    assert len(periodic_table()) == 119 and find_element("carbon").z == find_element("c").z == find_element(6).z == 6
    assert [(find_element(z).period, find_element(z).grp) for z in (1, 2, 5, 18, 26, 64, 72, 118)] == [(1, 1), (1, 18), (2, 13), (3, 18), (4, 8), (6, 3), (6, 4), (7, 18)]
    assert find_element("nothing") is None and find_element(500) is None


def test_rings_of_cubane_and_indole():
    cubane = read_smiles("C12C3C4C1C5C2C3C45")
    assert len(M.smallest_rings(cubane)) == 5 and len(M.relevant_rings(cubane)) == 6 and {len(r) for r in M.relevant_rings(cubane)} == {4}
    indole = read_smiles("c1ccc2[nH]ccc2c1")
    assert sorted(len(r) for r in M.all_rings(indole)[0]) == [5, 6, 9]
    assert M.all_rings(cubane, most=3)[1] is False


def test_charges():
    def q(line):
        m = read_smiles(line)
        sanitize(m)
        assert D.gasteiger(m) is None
        return [a.pcharge for a in m.atoms]

    assert q("CC")[0] == pytest.approx(-0.068, abs=5e-3)
    acetate = q("CC(=O)[O-]")
    assert acetate[2] == pytest.approx(acetate[3], abs=1e-6)
    guanidinium = q("NC(=[NH2+])N.[Cl-]")
    assert guanidinium[0] == pytest.approx(guanidinium[2], abs=1e-6) == pytest.approx(guanidinium[3], abs=1e-6) and guanidinium[4] == pytest.approx(-1)
    iron = read_smiles("C[Fe]")
    sanitize(iron)
    assert "charge type" in D.gasteiger(iron)


def test_surface_of_two_spheres():
    r, d = 1.5, 2.0
    area = D.surface_area(np.array([[0, 0, 0], [d, 0, 0.0]]), np.array([r, r]) - 1.4, 20000, 1.4)
    cap = 2 * math.pi * r * (r - d / 2)
    assert area == pytest.approx([4 * math.pi * r * r - cap] * 2, rel=1e-3)
    with pytest.raises(ValueError):
        D.surface_area(np.zeros((1, 3)), np.ones(1), 0)


def test_superposition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3))
    rot = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    rot *= np.sign(np.linalg.det(rot))
    m, rmsd = D.superpose(x, x @ rot.T + 3)
    assert rmsd == pytest.approx(0, abs=1e-6) and np.allclose(D.move(m, x), x @ rot.T + 3)
    mirrored = x * [1, 1, -1]
    assert D.superpose(x, mirrored)[1] > 0.1 and D.superpose(x, mirrored, True)[1] == pytest.approx(0, abs=1e-6)
    noisy = x @ rot.T
    noisy[:4] += 20
    _, keep, rmsd = D.trimmed_superpose(x, noisy)
    assert set(keep) >= set(range(4, 20)) - set(range(4)) and rmsd < 1e-6
    assert D.tm_score(10 * x, 10 * x @ rot.T)[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        D.superpose(x, x[:3])
    with pytest.raises(ValueError):
        D.superpose(x * np.nan, x)


def test_small_geometry():
    x = np.random.default_rng(2).normal(size=(12, 3))
    d2 = np.square(x[:, None] - x[None]).sum(2)
    y = D.embed_distances(d2)
    assert np.allclose(np.square(y[:, None] - y[None]).sum(2), d2)
    flat = x * [1, 1, 0] + [0, 0, 2]
    plane = D.fit_plane(flat)
    assert np.allclose(flat @ plane[:3] + plane[3], 0) and np.linalg.norm(plane[:3]) == pytest.approx(1)
    butane = read_smiles("CCCC")
    p = np.array([[0, 0, 0], [1.5, 0, 0], [2, 1.4, 0], [3.5, 1.4, 0.0]])
    q = p
    for _ in range(4):
        q = D.rotate_bond(butane, q, 1, 2, 90)
    assert np.allclose(q, p) and not np.allclose(D.rotate_bond(butane, p, 1, 2, 90), p)
    with pytest.raises(ValueError):
        D.rotate_bond(read_smiles("C1CC1"), p[:3], 0, 1, 10)


def test_minimisers():
    def rosen(x):
        a, b = x[1:] - x[:-1] ** 2, 1 - x[:-1]
        g = np.zeros_like(x)
        g[:-1] = -400 * x[:-1] * a - 2 * b
        g[1:] += 200 * a
        return float((100 * a**2 + b**2).sum()), g

    for method in (l_bfgs, bfgs):
        out = method(rosen, np.array([-1.2, 1.0, -0.5, 0.8]), steps=2000)
        assert out.fx < 1e-8 and np.allclose(out.x, 1, atol=1e-3)
    assert np.allclose(nelder_mead(lambda x: rosen(x)[0], np.array([-1.2, 1.0])).x, 1, atol=1e-2)
    bounded = l_bfgs_b(lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3)), np.zeros(3), (np.full(3, -1.0), np.array([1.0, 5.0, 2.0])))
    assert np.allclose(bounded.x, [1, 3, 2], atol=1e-5) and bounded.converged
    with pytest.raises(ValueError):
        nelder_mead(lambda x: 0.0, np.zeros((2, 2)))


def test_hydrogens_appear_and_hide():
    ethanol = read_smiles("CCO")
    sanitize(ethanol)
    assert generate_coords(ethanol)
    full = M.reveal_hydrogens(ethanol)
    assert len(full.atoms) == 9 and full.confs[0].shape == (9, 3)
    d = [np.linalg.norm(full.confs[0][b.src] - full.confs[0][b.dst]) for b in full.bonds if full.atoms[b.dst].z == 1]
    assert all(0.85 < x < 1.25 for x in d)
    assert [a.impl_h for a in M.hide_hydrogens(full).atoms] == [3, 2, 1]


@pytest.mark.parametrize("line", ["CCO", "c1ccccc1", "CC(=O)O", "C1CCCCC1", "CC#N"])
def test_coordinates_give_back_the_bonds(line):
    a = read_smiles(line)
    sanitize(a)
    a = M.reveal_hydrogens(a)
    sanitize(a)
    assert generate_coords(a, seed=3)
    b = M.Molecule()
    for x in a.atoms:
        b.add_atom(M.Atom(x.z))
    b.confs = a.confs
    guess_everything(b, slack=0.2)
    assert {(min(e.src, e.dst), max(e.src, e.dst)) for e in b.bonds} == {(min(e.src, e.dst), max(e.src, e.dst)) for e in a.bonds}


def test_chains_align():
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=(60, 3)) * 2.2, axis=0)
    rot = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    rot *= np.sign(np.linalg.det(rot))
    moved = (walk @ rot.T + 7)[10:55]
    found = align_chains(moved, walk)
    assert found.score()[1] == pytest.approx(45 / 60, abs=1e-3) and found.rmsd() < 1e-6
    assert (found.pairs[:, 1] - found.pairs[:, 0] == 10).all() and len(found.pairs) == 45
    with pytest.raises(ValueError):
        align_chains(walk[:4], walk)
    score = rng.random((9, 12))
    path = best_path(score, -0.6)
    assert (np.diff(path, axis=0) > 0).all()


def test_shapes_align():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 3)) * 3
    rot = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    rot *= np.sign(np.linalg.det(rot))
    kinds, radii = list(range(12)), np.full(12, 1.5)
    m, score = align_shapes(x @ rot.T + 5, radii, kinds, x, radii, kinds)
    assert score == pytest.approx(1, abs=1e-3) and np.allclose(D.move(m, x @ rot.T + 5), x, atol=0.05)


#: A molecule of 13 atoms, and areas of its atoms with 100 probes.
# Positions of a molecule and the areas that its atoms must have.
PHENOL = """
2.4823 0.0194 -0.3935 O
1.1083 0.0083 -0.2127 C
0.4038 -1.1740 -0.1422 C
-0.9783 -1.1878 0.0395 C
-1.6848 -0.0082 0.1548 C
-0.9667 1.1675 0.0823 C
0.4040 1.1892 -0.0978 C
3.1213 0.0076 0.3925 H
0.9144 -2.1260 -0.2274 H
-1.5181 -2.1041 0.0934 H
-2.7594 -0.0193 0.2961 H
-1.5030 2.1147 0.1708 H
0.9759 2.1126 -0.1557 H
"""
AREAS = (25.363962, 5.051128, 13.890602, 17.678948, 16.416166, 15.153384, 13.890602, 31.431006, 22.936140, 23.785626, 23.785626, 26.334086, 21.237166)


def test_surface_of_phenol():
    rows = [x.split() for x in PHENOL.strip().splitlines()]
    radii = np.array([find_element(r[3]).vdw_radius for r in rows])
    assert D.surface_area(np.array([r[:3] for r in rows], float), radii, 100) == pytest.approx(AREAS, rel=1e-5)


SDF = """water
  made

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 O   0  0
    0.9600    0.0000    0.0000 H   0  0
   -0.2400    0.9300    0.0000 D   0  0
  1  2  1  0
  1  3  1  0
M  CHG  1   1   0
M  END
> 1 <NAME>
some
text

> DT5
more

$$$$
"""


def test_connection_tables():
    m = sdf.read_sdf(next(sdf.records(SDF)))
    assert [a.z for a in m.atoms] == [8, 1, 1] and m.atoms[2].isotope == 2 and m.props["NAME"] == "some\ntext" and m.props["DT5"] == "more"
    for version in (2000, 3000):
        again = sdf.read_sdf(sdf.write_sdf(m, version=version))
        assert [(a.z, a.isotope, a.fcharge) for a in again.atoms] == [(a.z, a.isotope, a.fcharge) for a in m.atoms] and np.allclose(again.confs[0], m.confs[0])
        assert again.props["NAME"] == "some\ntext"
    wide = sdf.write_sdf(m, version=3000).replace("M  V30 BEGIN ATOM", "M  V30 BEGIN -\nM  V30 ATOM")
    assert len(sdf.read_sdf(wide).atoms) == 3
    for bad in ("a\nb\nc", SDF.replace("  3  2", "  3  9", 1), SDF.replace(" O  ", " Zz ", 1), SDF.replace("  1  3  1", "  1  1  1"), SDF.replace("  3  2", "  x  2", 1)):
        with pytest.raises(sdf.SdfError):
            sdf.read_sdf(bad)


def test_typed_sections():
    m = read_smiles("CC(=O)[O-]")
    sanitize(m)
    text = mol2.write_mol2(m)
    assert "O.co2" in text and "C.2" in text
    again = mol2.read_mol2(next(mol2.records("# a comment\n" + text)))
    assert [(a.z, a.fcharge) for a in again.atoms] == [(a.z, a.fcharge) for a in m.atoms]
    for bad in ("x", "@<TRIPOS>MOLECULE\nm\n@<TRIPOS>ATOM\n1 C a 0 0 C.3\n", "@<TRIPOS>MOLECULE\nm\n@<TRIPOS>ATOM\n1 C 0 0 0 C.3\n@<TRIPOS>BOND\n1 1 2 1\n"):
        with pytest.raises(mol2.Mol2Error):
            mol2.read_mol2(bad)


def test_fixed_width_models():
    line = pdb.atom_line
    a = [line(1, "N", "ALA", "A", 1, (0, 0, 0), "N"), line(2, "CA", "ALA", "A", 1, (1.5, 0, 0), "C", occupancy=0.4)[:16] + "A" + line(2, "CA", "ALA", "A", 1, (1.5, 0, 0), "C", occupancy=0.4)[17:], line(3, "CA", "ALA", "A", 1, (1.6, 0, 0), "C", occupancy=0.6)[:16] + "B" + line(3, "CA", "ALA", "A", 1, (1.6, 0, 0), "C", occupancy=0.6)[17:], line(4, "ZN", "ZN", "B", 2, (9, 9, 9), "Zn", charge=2), "CONECT    1    2"]
    model = pdb.read_model(a)
    assert len(model["atoms"]) == 3 and [s["altloc"] for s in model["atoms"][1]["sites"]] == ["B", "A"] and len(model["chains"]) == 2
    mol = pdb.read_pdb(a)
    assert len(mol.confs) == 2 and mol.confs[0][1][0] == 1.5 and mol.confs[1][1][0] == 1.6 and len(mol.bonds) == 1 and mol.atoms[2].fcharge == 2
    text = pdb.write_pdb(mol)
    assert len(list(pdb.models(text))) == 2 and "HETATM" in text
    with pytest.raises(ValueError):
        line(1, "C", "ALA", "A", 1, (1e5, 0, 0), "C")


def test_dictionary_files():
    text = "data_x\n_a.b 'it''s'\n_a.c ?\nloop_\n_l.k\n_l.v\n1 .\n2 \"two words\"\n3\n;several\nlines\n;\nsave_s\n_s.a '?'\nsave_\n# end\n"
    (block,) = cif.read_blocks(text)
    assert block.tables[0] == (["_a.b", "_a.c"], [[("it''s", cif.QUOTED), ("?", cif.UNKNOWN)]])
    assert block.tables[1][1] == [[("1", 0), (".", cif.INAPPLICABLE)], [("2", 0), ("two words", 1)], [("3", 0), ("several\nlines", 1)]]
    assert block.saves[0].tables[0][1] == [[("?", cif.QUOTED)]]
    for align in (False, True):
        again = cif.read_blocks(cif.write(block, align))[0]
        assert [[v for v, _ in row] for _, rows in again.tables for row in rows] == [[v for v, _ in row] for _, rows in block.tables for row in rows]
    for bad in ("_a 1", "data_x\nloop_\n_a\n_b\n1 2 3", "data_x\n_a", "data_x\n_a 'open", "data_x\nsave_a\nsave_b\nsave_", "data_x\n_a\n;open"):
        with pytest.raises(cif.CifError):
            cif.read_blocks(bad)
    assert [cif.format_value(v) for v in (None, True, 5, 1.5, "1.5", "a b", "", "data_x", "it's")] == ["?", "yes", "5", "1.5", "'1.5'", "'a b'", "''", "'data_x'", "it's"]
    assert cif.format_value(True, short=True) == "y" and cif.format_value(7, width=3) == "007" and cif.format_value(1.5, precision=2) == "1.50" and cif.format_value(float("-inf"), coerce=True) == "-8e+88888888"
    with pytest.raises(ValueError):
        cif.format_value(float("nan"))
    assert cif.validate(cif.Frame("x", [(["_a", "_a"], [])])) == "_a comes twice" and cif.validate(cif.Frame("x", [(["a"], [])])) and cif.validate(block) is None


def stripped(mol, hydrogens=False, charges=False):
    """The molecule with elements and bonds, and with what is asked for."""
    out = M.Molecule()
    for a in mol.atoms:
        out.add_atom(M.Atom(a.z, impl_h=a.impl_h if hydrogens else 0, fcharge=a.fcharge if charges else 0))
    for b in mol.bonds:
        out.add_bond(b.src, b.dst, b.bo)
    return out.finish()


@pytest.mark.parametrize("line", ["CC(=O)O", "c1cc[nH]c1", "c1ccncc1", "c1c[nH]cn1", "c1ccc2[nH]ccc2c1", "C[N+](C)(C)C", "c1cc[o+]cc1", "[Na+].[Cl-]", "O=[N+]([O-])c1ccccc1", "CC(=O)[O-]", "C[NH3+]", "c1ccc2ccccc2c1", "[cH-]1cccc1", "C[n+]1ccccc1", "CS(=O)(=O)N", "OP(=O)(O)O", "C#N", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "F[B-](F)(F)F", "[Mg+2].[Cl-].[Cl-]"])
def test_charges_and_hydrogens_of_drawn_structures(line):
    mol = read_smiles(line)
    charges, hydrogens = stripped(mol, hydrogens=True), stripped(mol, charges=True)
    guess_charges(charges)
    guess_hydrogens(hydrogens)
    assert [a.fcharge for a in charges.atoms] == [a.fcharge for a in mol.atoms]
    assert [a.impl_h for a in hydrogens.atoms] == [a.impl_h for a in mol.atoms]
    both = stripped(mol)
    guess_charges_and_hydrogens(both)
    assert sanitize(both) is None
    if line in ("CC(=O)O", "c1cc[nH]c1", "C[N+](C)(C)C", "c1cc[o+]cc1", "[Na+].[Cl-]", "C[n+]1ccccc1", "F[B-](F)(F)F", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"):
        assert [(a.fcharge, a.impl_h) for a in both.atoms] == [(a.fcharge, a.impl_h) for a in mol.atoms]


def test_localised_structures():
    for line, doubles in (("c1ccccc1", 3), ("c1ccc2cccc2cc1", 5), ("c1cc[nH]c1", 2), ("c1cc2ccc3cccc4ccc(c1)c2c34", 8), ("O=c1cc[nH]cc1", 2), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", 2)):
        mol = read_smiles(line)
        orders = localised_orders(mol)
        shared = [i for i, b in enumerate(mol.bonds) if b.bo == M.AROMATIC]
        assert sum(orders[i] == 2 for i in shared) == doubles and all(orders[i] in (1, 2) for i in shared)
        assert all(sum(orders[e] == 2 for _, e in mol.near[i]) <= 1 for i in range(len(mol.atoms)))
    odd = M.Molecule()
    for _ in range(5):
        odd.add_atom(M.Atom(6, impl_h=1))
    for i in range(5):
        odd.add_bond(i, (i + 1) % 5, M.AROMATIC)
    assert localised_orders(odd.finish()) is None


@pytest.mark.parametrize(("line", "kinds"), [("CC(=O)NC", "C.3 C.2 O.2 N.am C.3"), ("CC(=O)[O-]", "C.3 C.2 O.co2 O.co2"), ("NC(=[NH2+])N", "N.pl3 C.cat N.2 N.pl3"), ("CS(=O)(=O)C", "C.3 S.O2 O.2 O.2 C.3"), ("CS(=O)C", "C.3 S.O O.2 C.3"), ("C#N", "C.1 N.1"), ("c1ccncc1", "C.ar C.ar C.ar N.ar C.ar C.ar"), ("C[N+](C)(C)C", "C.3 N.4 C.3 C.3 C.3"), ("C=C=C", "C.2 C.1 C.2"), ("CP(=O)([O-])[O-]", "C.3 P.3 O.co2 O.co2 O.co2"), ("Nc1ccccc1", "N.pl3 C.ar C.ar C.ar C.ar C.ar C.ar"), ("ClCBr", "Cl C.3 Br"), ("CSC", "C.3 S.3 C.3"), ("CC(=S)N", "C.3 C.2 S.2 N.am")])
def test_type_names(line, kinds):
    mol = read_smiles(line)
    sanitize(mol)
    assert " ".join(mol2.atom_type(mol, i) for i in range(len(mol.atoms))) == kinds


def small_graphs(seed=4, n=40):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        size = int(rng.integers(3, 9))
        mol = M.Molecule()
        for _ in range(size):
            mol.add_atom(M.Atom(6))
        for i in range(size):
            for j in range(i):
                if rng.random() < 0.4:
                    mol.add_bond(i, j)
        yield mol.finish()


def cycles_of(mol):
    """All simple cycles as sets of bonds, by walking every path."""
    found = {}

    def walk(start, at, seen, used):
        for j, e in mol.near[at]:
            if j == start and len(seen) > 2 and e not in used:
                found.setdefault(frozenset((*used, e)), len(seen))
            elif j > start and j not in seen:
                walk(start, j, (*seen, j), (*used, e))

    for i in range(len(mol.atoms)):
        walk(i, i, (i,), ())
    return found


def independent(vectors):
    """Rank of sets of bonds under symmetric difference."""
    basis = []
    for v in vectors:
        v = sum(1 << e for e in v)
        for b in basis:
            v = min(v, v ^ b)
        if v:
            basis.append(v)
    return len(basis)


def test_rings_equal_brute_force():
    """All rings, relevant rings (no sum of shorter ones) and the size of the least basis."""
    def bonds_of(mol, ring):
        return frozenset(mol.find_bond(a, b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))

    for mol in small_graphs():
        every = cycles_of(mol)
        found, whole = M.all_rings(mol, most=10**9)
        assert whole and {bonds_of(mol, r) for r in found} == set(every) and len(found) == len(every)
        relevant = set()
        for c, n in every.items():
            shorter = [x for x, m in every.items() if m < n]
            if independent([*shorter, c]) > independent(shorter):
                relevant.add(c)
        assert {bonds_of(mol, r) for r in M.relevant_rings(mol)} == relevant
        least = M.smallest_rings(mol)
        assert independent([bonds_of(mol, r) for r in least]) == len(least) == mol.num_sssr
        basis, total = [], 0
        for c, n in sorted(every.items(), key=lambda x: x[1]):
            if independent([*basis, c]) > len(basis):
                basis.append(c)
                total += n
        assert sum(map(len, least)) == total


def test_connectivity_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        mol = M.Molecule()
        for z in rng.choice([1, 6, 7, 8, 16, 26], 14):
            mol.add_atom(M.Atom(int(z)))
        x = rng.normal(0, 2, (14, 3))
        mol.confs = [x]
        guess_connectivity(mol, slack=0.4)
        left = [1 if a.z == 1 else 4 if a.element.period == 2 else 6 for a in mol.atoms]
        want = set()
        for d, i, j in sorted((float(np.linalg.norm(x[i] - x[j])), j, i) for i in range(14) for j in range(i)):
            a, b = mol.atoms[i], mol.atoms[j]
            if 26 not in (a.z, b.z) and d <= a.element.cov_radius + b.element.cov_radius + 0.4 and left[i] and left[j]:
                left[i], left[j] = left[i] - 1, left[j] - 1
                want.add((i, j))
        assert {(min(b.src, b.dst), max(b.src, b.dst)) for b in mol.bonds} == want


def test_alignments_tell_what_they_do():
    """Scores are those of the motion and pairs that come with them, and not below a plain superposition's."""
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.normal(0, 2, (40, 3)), 0)
    y = x @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + rng.normal(0, 1.5, x.shape)
    score, motion = D.tm_score(x, y)
    d0 = D.tm_scale(40)
    of = lambda m: float((1 / (1 + np.square(D.move(m, x) - y).sum(1) / d0**2)).sum() / 40)
    assert score == pytest.approx(of(motion)) and score >= of(D.superpose(x, y)[0])
    m, keep, rmsd = D.trimmed_superpose(x, y, cutoff=2.0)
    off = np.square(D.move(m, x[keep]) - y[keep]).sum(1)
    assert rmsd == pytest.approx(math.sqrt(off.mean()), abs=1e-9)
    kinds, r = [6] * 12, np.full(12, 1.4)
    q, t = x[:12], D.move(motion, x[:12]) + 0.3
    move, share = align_shapes(q, r, kinds, t, r, kinds)
    own = D.shape_overlap(r, kinds, t, r, kinds, t)
    assert share == pytest.approx(D.shape_overlap(r, kinds, D.move(move, q), r, kinds, t) / own, abs=1e-9) and share > 0.9


def test_flexible_alignment_beats_a_rigid_one():
    mol = read_smiles("CCCCCO")
    sanitize(mol)
    assert generate_coords(mol)
    x = mol.confs[0]
    assert rotatable_bonds(mol) == [(1, 2), (2, 3), (3, 4)]
    bent = D.rotate_bond(mol, D.rotate_bond(mol, x, 1, 2, 110), 3, 4, -80)
    kinds, r = [a.z for a in mol.atoms], np.array([0.8 * a.element.vdw_radius for a in mol.atoms])
    rigid = align_shapes(x, r, kinds, bent, r, kinds)[1]
    placed, share = align_flexible(mol, x, r, bent, r, kinds)
    assert share > max(0.9, rigid) and placed.shape == x.shape
    own = D.shape_overlap(r, kinds, bent, r, kinds, bent)
    assert share == pytest.approx(D.shape_overlap(r, kinds, placed, r, kinds, bent) / own, abs=1e-9)
    for b in mol.bonds:  # lengths stay
        assert np.linalg.norm(placed[b.src] - placed[b.dst]) == pytest.approx(np.linalg.norm(x[b.src] - x[b.dst]))


TYPED = "CCO CC(=O)O CC(=O)[O-] c1ccccc1 c1ccncc1 c1cc[nH]c1 CC#N C#CC C=CC=C O=C1CCCN1 CC(=O)NC Cn1cnc2c1c(=O)n(C)c(=O)n2C CS(=O)(=O)C CS(=O)C O=[N+]([O-])c1ccccc1 C[N+](C)(C)C NC(=[NH2+])N OP(=O)(O)OC C1CCCCC1 c1ccc2ccccc2c1 c1ccc2[nH]ccc2c1 c1ccoc1 c1ccsc1 C=O N#Cc1ccccc1 O=C1C=CC(=O)C=C1 Nc1ccccc1 C1CC1 CN=[N+]=[N-] Oc1ccccc1 CC(C)=O c1cnc[nH]1 CSC C=C FC(F)F Clc1ccccc1Br".split()


@pytest.mark.parametrize("line", TYPED)
def test_types_from_coordinates(line):
    """Bonds and charges of a structure with hydrogens are found again from its coordinates; without hydrogens, where lengths and angles tell."""
    for full in (True, False):
        mol = read_smiles(line)
        sanitize(mol)
        if full:
            mol = M.reveal_hydrogens(mol)
            sanitize(mol)
        assert generate_coords(mol)
        bare = M.Molecule()
        for a in mol.atoms:
            bare.add_atom(M.Atom(a.z))
        for b in mol.bonds:
            bare.add_bond(b.src, b.dst)
        bare.confs = mol.confs
        assert guess_types(bare.finish()) is None
        if full or line not in ("CC(=O)[O-]", "NC(=[NH2+])N", "CN=[N+]=[N-]", "c1cnc[nH]1"):
            assert [(a.fcharge, a.impl_h, a.aromatic) for a in bare.atoms] == [(a.fcharge, a.impl_h, a.aromatic) for a in mol.atoms], full


def test_coordinates_keep_the_hands_of_centres():
    def hand(line):
        mol = read_smiles(line)
        sanitize(mol)
        assert generate_coords(mol)
        x = mol.confs[0]
        first = {mol.atoms[j].z: j for j, _ in mol.near[1]}
        a, b, c = (x[first[z]] - x[1] for z in (7, 6, 8))
        return a @ np.cross(b, c) > 0

    # The same centre, its neighbours told in another order with the mark that this asks for.
    assert hand("N[C@@H](C)O") == hand("N[C@H](O)C") == hand("N[C@@](O)(F)C") != hand("N[C@H](C)O") == hand("N[C@@H](O)C")


def test_frames_of_models():
    atom = "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.00           C"
    text = f"HEADER    X\nMODEL        1\n{atom}\nENDMDL\nMODEL        2\n{atom}\nENDMDL\nCONECT    1    2\nMASTER    0\nEND\n\n"
    head, parts, foot = pdb.frame(text)
    assert head == ["HEADER    X"] and [(n, len(x)) for n, x in parts] == [(1, 1), (2, 1)] and foot == ["CONECT    1    2", "MASTER    0", "END"]
    assert pdb.frame(f"REMARK 1\n{atom}\nTER\nCONECT    1    2\nEND") == (["REMARK 1"], [(1, [atom, "TER"])], ["CONECT    1    2", "END"])
    assert pdb.frame("") == ([], [(1, [])], []) and [n for n, _ in pdb.models(text)] == [1, 2]
    assert pdb.frame(f"MODEL     7\n{atom}\nMODEL     8\n{atom}\n")[1] == [(7, [atom]), (8, [atom])]  # without end records


def test_hydrogens_turn_away():
    """Relaxed hydrogens are no nearer to other atoms than unrelaxed ones, and keep their bonds' lengths."""
    mol = read_smiles("CC(C)(C)C(C)O")
    sanitize(mol)
    assert generate_coords(mol)

    def nearest(full):
        x, gap = full.confs[0], []
        for i, a in enumerate(full.atoms):
            if a.z == 1:
                hub = full.near[i][0][0]
                gap += [np.linalg.norm(x[i] - x[k]) for k in range(len(x)) if k not in (i, hub) and not (full.atoms[k].z == 1 and full.near[k][0][0] == hub)]
        return min(gap)

    plain, relaxed = M.reveal_hydrogens(mol, relax=False), M.reveal_hydrogens(mol)
    assert nearest(relaxed) >= nearest(plain) - 1e-9
    for m in (plain, relaxed):
        assert all(0.85 < np.linalg.norm(m.confs[0][b.src] - m.confs[0][b.dst]) < 1.25 for b in m.bonds if m.atoms[b.dst].z == 1)
