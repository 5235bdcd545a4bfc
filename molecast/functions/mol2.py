"""Sectioned molecule files with atom types: reading and writing."""

from __future__ import annotations

import numpy as np

from .elements import by_symbol
from .molecule import AROMATIC, DOUBLE, OTHER, SINGLE, SP, SP2, SP3, TRIPLE, Atom, Molecule
from .sdf import fill_hydrogens

TAG = "@<TRIPOS>"
ORDERS = {"1": SINGLE, "2": DOUBLE, "3": TRIPLE, "am": SINGLE, "ar": AROMATIC, "du": SINGLE, "un": SINGLE}
HYBS = {"1": SP, "2": SP2, "3": SP3, "ar": SP2, "cat": SP2, "am": SP2, "pl3": SP2, "4": SP3, "co2": SP2, "o": SP3, "o2": SP3, "oh": SP3, "th": SP3}


class Mol2Error(ValueError):
    """The record isn't valid."""


def records(text: str):
    """The records of a file; lines that start with # are comments."""
    held: list[str] = []
    for line in text.splitlines():
        if line.startswith("#"):
            continue
        if line.startswith(f"{TAG}MOLECULE") and held:
            yield "\n".join(held)
            held = []
        if held or line.startswith(f"{TAG}MOLECULE"):
            held.append(line)
    if held:
        yield "\n".join(held)


def read_mol2(record: str) -> Molecule:
    """The molecule of a record."""
    parts: dict[str, list[str]] = {}
    at: list[str] | None = None
    for line in record.splitlines():
        if line.startswith(TAG):
            at = parts.setdefault(line[len(TAG) :].strip(), [])
        elif at is not None:
            at.append(line)
    if "MOLECULE" not in parts or not parts["MOLECULE"]:
        raise Mol2Error("no molecule section")
    mol, place, xyz, subs = Molecule(), {}, [], {}
    mol.name = parts["MOLECULE"][0].strip()
    for line in parts.get("ATOM", ()):
        w = line.split()
        if not w:
            continue
        if len(w) < 6:
            raise Mol2Error(f"atom {line!r}")
        symbol, _, kind = w[5].partition(".")
        e = by_symbol().get(symbol.capitalize())
        if e is None and symbol not in ("Du", "Any", "LP", "Hal", "Het", "Hev"):
            raise Mol2Error(f"no element {symbol!r}")
        atom = Atom(e.z if e else 0, hyb=HYBS.get(kind, OTHER), aromatic=kind == "ar", name=w[1])
        if symbol == "N" and kind == "4":
            atom.fcharge = 1
        try:
            xyz.append([float(v) for v in w[2:5]])
            if len(w) > 8:
                atom.pcharge = float(w[8])
        except ValueError:
            raise Mol2Error(f"atom {line!r}") from None
        i = place[w[0]] = mol.add_atom(atom)
        if len(w) > 7:
            subs.setdefault((w[6], w[7]), []).append(i)
    for line in parts.get("BOND", ()):
        w = line.split()
        if not w or len(w) > 3 and w[3] == "nc":
            continue
        if len(w) < 4 or w[1] not in place or w[2] not in place or w[3] not in ORDERS or w[1] == w[2]:
            raise Mol2Error(f"bond {line!r}")
        mol.add_bond(place[w[1]], place[w[2]], ORDERS[w[3]])
    charged, lines = False, parts.get("UNITY_ATOM_ATTR", [])
    for k, line in enumerate(lines):
        w = line.split()
        if len(w) == 2 and w[0] == "charge" and k and (head := next((x.split() for x in reversed(lines[:k]) if len(x.split()) == 2 and x.split()[0] in place), None)):
            mol.atoms[place[head[0]]].fcharge, charged = int(w[1]), True
    named = {(w[0], w[1]) for w in map(str.split, parts.get("SUBSTRUCTURE", ())) if len(w) > 1}
    for (n, name), ids in subs.items():
        if (n, name) in named:
            mol.subs.append({"name": name, "id": int(n) if n.lstrip("-").isdigit() else 0, "category": 1, "atom_ids": ids, "props": {}})
    mol.confs = [np.array(xyz)] if xyz else []
    mol.finish()
    _fix_bonds(mol)
    _nitro(mol)
    if not charged:
        _carboxylates(mol)
    if not any(a.z == 1 for a in mol.atoms):
        fill_hydrogens(mol)
    return mol


def _fix_bonds(mol: Molecule) -> None:
    """Aromatic bonds out of rings stand for shared double bonds (carboxylates, guanidinium): one of an atom's becomes double, the others single."""
    for i in range(len(mol.atoms)):
        loose = [(j, e) for j, e in mol.near[i] if mol.bonds[e].bo == AROMATIC and not mol.bonds[e].ring]
        if len(loose) < 2:
            continue
        loose.sort(key=lambda x: (len(mol.near[x[0]]) > 1 and mol.atoms[x[0]].z != 7, x[0]))
        for k, (j, e) in enumerate(loose):
            mol.bonds[e].bo = DOUBLE if k == 0 else SINGLE
            if k == 0 and mol.atoms[j].z == 7:
                mol.atoms[j].fcharge = 1
    for b in mol.bonds:
        if b.bo == AROMATIC:
            if not b.ring:
                b.bo = SINGLE
            else:
                b.aromatic = mol.atoms[b.src].aromatic = mol.atoms[b.dst].aromatic = True


def _nitro(mol: Molecule) -> None:
    """A nitrogen with five bonds, two of them double to bare oxygens, is charged, and so is one of these."""
    for i, a in enumerate(mol.atoms):
        ends = [(j, e) for j, e in mol.near[i] if mol.atoms[j].z == 8 and len(mol.near[j]) == 1 and mol.bonds[e].bo == DOUBLE]
        if a.z == 7 and len(ends) == 2 and sum(mol.orders(i)) == 5:
            mol.bonds[ends[1][1]].bo, mol.atoms[ends[1][0]].fcharge, a.fcharge = SINGLE, -1, 1


def _carboxylates(mol: Molecule) -> None:
    """Bare singly bonded oxygens next to a doubly bonded one are charged."""
    for i, a in enumerate(mol.atoms):
        if a.z == 8 and a.hyb == SP2 and mol.orders(i) == [SINGLE] and not mol.hydrogens(i):
            a.fcharge = -1


#: Type names of carbon, nitrogen, oxygen, sulfur and phosphorus by what their bonds are like.
LINEAR, FLAT, ROUND = {6: "C.1", 7: "N.1"}, {6: "C.2", 7: "N.2", 8: "O.2", 16: "S.2"}, {6: "C.3", 7: "N.3", 8: "O.3", 15: "P.3", 16: "S.3"}
#: Type names of metals by their neighbours.
METALS = {24: (("Cr.oh", 6), ("Cr.th", 0)), 27: (("Co.oh", 0),)}


def _acid(mol: Molecule, i: int) -> bool:
    """Whether an oxygen shares a charge with another bare one at a carbon or phosphorus."""
    if len(mol.near[i]) != 1 or mol.hydrogens(i):
        return False
    hub = mol.near[i][0][0]
    bare = [k for k, _ in mol.near[hub] if mol.atoms[k].z == 8 and mol.all_neighbours(k) == 1]
    return mol.atoms[hub].z in (6, 15) and len(bare) > 1 and any(mol.atoms[k].fcharge < 0 for k in bare)


def _carbonyls(mol: Molecule, i: int) -> list[int]:
    """Neighbours by a single bond that are carbons doubly bonded to oxygen or sulfur: what makes a nitrogen an amide's."""
    return [j for j, e in mol.near[i] if mol.atoms[j].z == 6 and mol.bonds[e].bo == SINGLE and any(mol.bonds[f].bo == DOUBLE and mol.atoms[k].z in (8, 16) for k, f in mol.near[j])]


def _shape(mol: Molecule, i: int) -> int:
    """Hybridization; by the bond orders where it is unknown or the atom ends a chain."""
    a, orders = mol.atoms[i], mol.orders(i)
    if a.hyb in (SP, SP2, SP3) and mol.all_neighbours(i) > 1:
        return a.hyb
    if TRIPLE in orders or orders.count(DOUBLE) > 1:
        return SP
    return SP2 if DOUBLE in orders or AROMATIC in orders else SP3


def atom_type(mol: Molecule, i: int) -> str:
    """The type name of an atom."""
    a = mol.atoms[i]
    if a.z == 0:
        return "Du"
    if a.z in METALS:
        return next(name for name, least in METALS[a.z] if len(mol.near[i]) >= least)
    shape = _shape(mol, i)
    if a.z == 6:
        amino = [j for j, _ in mol.near[i] if mol.atoms[j].z == 7]
        if a.aromatic:
            return "C.ar"
        if shape == SP2 and len(amino) == 3 and (any(mol.atoms[j].fcharge > 0 for j in amino) or a.fcharge > 0):
            return "C.cat"
    elif a.z == 7:
        if a.aromatic:
            return "N.ar"
        if mol.all_neighbours(i) == 4:
            return "N.4"
        if _carbonyls(mol, i):
            return "N.am"
        if shape == SP2 and DOUBLE not in mol.orders(i):
            return "N.pl3"
    elif a.z == 8:
        if _acid(mol, i):
            return "O.co2"
        shape = SP2 if a.aromatic or DOUBLE in mol.orders(i) else SP3
    elif a.z == 16:
        oxides = sum(mol.atoms[j].z == 8 and len(mol.near[j]) == 1 and (mol.bonds[e].bo == DOUBLE or mol.atoms[j].fcharge < 0) for j, e in mol.near[i])
        if len(mol.near[i]) > 2 and oxides:
            return "S.O2" if oxides > 1 else "S.O"
        shape = SP2 if a.aromatic or DOUBLE in mol.orders(i) else SP3
    elif a.z == 15:
        shape = SP3
    names = {SP: {**FLAT, **LINEAR}, SP2: FLAT}.get(shape, ROUND)
    return names.get(a.z) or ROUND.get(a.z) or a.element.symbol


def write_mol2(mol: Molecule, conf: int | None = None, write_sub: bool = True) -> str:
    """Records of one conformer, or of all."""
    confs = (mol.confs if conf is None else [mol.confs[conf]]) or [np.zeros((len(mol.atoms), 3))]
    subs = [s for s in mol.subs if s["atom_ids"] and s["category"] != 2] if write_sub else []
    of = {i: (k + 1, s["name"] or "UNK") for k, s in reversed(list(enumerate(subs))) for i in s["atom_ids"]}
    base = [a.name or (a.element.symbol if a.z else "Du") for a in mol.atoms]
    seen, names = {}, []
    for b in base:
        seen[b] = seen.get(b, 0) + 1
        names.append(b if base.count(b) == 1 else f"{b}{seen[b]}")
    kinds = [atom_type(mol, i) for i in range(len(mol.atoms))]

    def bond_type(b) -> str:
        if b.bo == AROMATIC or b.aromatic:
            return "ar"
        if b.bo == SINGLE and {"N.am"} & {kinds[b.src], kinds[b.dst]} and any(b.other(i) in _carbonyls(mol, i) for i in (b.src, b.dst)):
            return "am"
        return str(b.bo) if b.bo in (1, 2, 3) else "un"

    out = []
    for c in confs:
        out += [f"{TAG}MOLECULE", mol.name or "****", f"{len(mol.atoms)} {len(mol.bonds)} {len(subs)}", "SMALL", mol.props.get("mol2_charge_type", "USER_CHARGES"), "", f"{TAG}ATOM"]
        out += [f"{i + 1:>6} {names[i]:<6} {x:10.4f} {y:10.4f} {z:10.4f} {kinds[i]:<6} {of.get(i, (1, 'UNK'))[0]:>4} {of.get(i, (1, 'UNK'))[1]:<6} {a.pcharge:8.4f}" for i, (a, (x, y, z)) in enumerate(zip(mol.atoms, c, strict=True))]
        if any(a.fcharge for a in mol.atoms):
            out.append(f"{TAG}UNITY_ATOM_ATTR")
            for i, a in enumerate(mol.atoms):
                if a.fcharge:
                    out += [f"{i + 1} 1", f"charge {a.fcharge}"]
        out.append(f"{TAG}BOND")
        out += [f"{i + 1:>6} {b.src + 1:>5} {b.dst + 1:>5} {bond_type(b)}" for i, b in enumerate(mol.bonds)]
        if subs:
            out.append(f"{TAG}SUBSTRUCTURE")
            out += [f"{k + 1:>6} {s['name'] or 'UNK'} {s['atom_ids'][0] + 1}" for k, s in enumerate(subs)]
    return "\n".join(out) + "\n"
