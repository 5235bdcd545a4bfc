"""Formal charges and implicit hydrogens from a drawn structure: elements, bonds and what is known of the other one.

An atom's bonds are compared with the usual valences of the element that it is alike
to once it is charged: nitrogen with four bonds is like carbon, so it has a charge of
+1. Aromatic rings that have no localised structure lack a hydrogen on a nitrogen, or
else a charge.
"""

from __future__ import annotations

from .elements import periodic_table
from .molecule import AROMATIC, DOUBLE, SINGLE, Molecule, smallest_rings
from .perception import Ledger, localised_orders

#: Usual valences of neutral atoms.
USUAL = {1: (1,), 2: (0,), 5: (3,), 6: (4,), 7: (3,), 8: (2,), 9: (1,), 10: (0,), 13: (3,), 14: (4,), 15: (3, 5), 16: (2, 4, 6), 17: (1,), 18: (0,), 32: (4,), 33: (3, 5), 34: (2, 4, 6), 35: (1,), 36: (0,), 50: (4,), 51: (3, 5), 52: (2, 4, 6), 53: (1, 3, 5), 54: (0,)}


def usual(z: int, charge: int) -> tuple[int, ...]:
    """Usual valences of a charged atom: those of the element with as many electrons in the same period; none if there is no such element."""
    alike, table = z - charge, periodic_table()
    if not 0 < alike < len(table) or (alike != z and table[alike].period != table[z].period and alike not in (2, 10, 18, 36, 54)):
        return ()
    return USUAL.get(alike, ())


def charge_nitro(mol: Molecule) -> None:
    """Nitrogen with five bonds gives one of its doubly bonded bare oxygens a charge, and has one itself."""
    for i, a in enumerate(mol.atoms):
        oxides = [(j, e) for j, e in mol.near[i] if mol.atoms[j].z == 8 and len(mol.near[j]) == 1 and mol.bonds[e].bo == DOUBLE]
        if a.z == 7 and len(oxides) > 1 and sum(max(mol.bonds[e].bo, 1) for _, e in mol.near[i]) == 5:
            j, e = max(oxides)
            mol.bonds[e].bo = SINGLE
            a.fcharge, mol.atoms[j].fcharge = 1, -1


def charge_for(z: int, bonds: int) -> int:
    """The smallest charge, positive before negative, that makes so many bonds usual; 0 if none does, as for a radical."""
    element = periodic_table()[z]
    if bonds == 0 and element.kind == "metal":
        return element.valence if element.main_group and element.valence < 4 else 0
    if z not in USUAL or bonds in USUAL[z] or z == 6:
        return 0
    return next((q for q in (1, -1, 2, -2) if bonds in usual(z, q)), 0)


def guess_charges(mol: Molecule) -> None:
    """Formal charges of atoms whose hydrogens are known."""
    for a in mol.atoms:
        a.fcharge = 0
    charge_nitro(mol)
    settled = Ledger(mol).settled.tolist()
    for i, a in enumerate(mol.atoms):
        if not a.fcharge:
            a.fcharge = charge_for(a.z, settled[i])
    balance_rings(mol, hydrogens=False, charges=True)


def _room(z: int, charge: int, bonds: int) -> int:
    fit = usual(z, charge)
    return max(0, next((v for v in fit if v >= bonds), bonds) - bonds) if fit else 0


def balance_rings(mol: Molecule, hydrogens: bool, charges: bool) -> None:
    """Where the delocalised bonds have no localised structure, a two-bonded nitrogen (or carbon anion) without hydrogen gets one, those of the smallest rings first; if none helps, a ring nitrogen or chalcogen gets +1, or a carbon -1. Only what may change does."""
    left = {i for i in range(len(mol.atoms)) if any(mol.bonds[e].bo == AROMATIC for _, e in mol.near[i])}
    while left:  # one system of delocalised bonds after another
        todo = [left.pop()]
        system = set(todo)
        while todo:
            new = {j for j, e in mol.near[todo.pop()] if mol.bonds[e].bo == AROMATIC and j in left}
            left -= new
            system |= new
            todo += new
        if localised_orders(mol, system) is None:
            _balance(mol, system, hydrogens, charges)


def _balance(mol: Molecule, system: set[int], hydrogens: bool, charges: bool) -> None:
    ring = sorted(system)
    least = {i: min((len(r) for r in smallest_rings(mol) if i in r), default=0) for i in ring}
    tries = []
    if hydrogens:
        lone = [i for i in ring if (mol.atoms[i].z == 7 or mol.atoms[i].z == 6 and mol.atoms[i].fcharge < 0) and len(mol.near[i]) == 2 and not mol.hydrogens(i)]
        tries += [(i, "impl_h", 1) for i in sorted(lone, key=lambda i: (least[i], i))]
    if charges:
        plain = [i for i in ring if not mol.atoms[i].fcharge]
        tries += [(i, "fcharge", 1) for i in plain if mol.atoms[i].z == 7 and mol.all_neighbours(i) == 3] + [(i, "fcharge", 1) for i in plain if mol.atoms[i].z in (8, 16, 34)] + [(i, "fcharge", -1) for i in plain if mol.atoms[i].z == 6 and least[i] < 6]

    def change(i: int, what: str, by: int) -> bool:
        """Whether there is a localised structure after a change."""
        setattr(mol.atoms[i], what, getattr(mol.atoms[i], what) + by)
        return localised_orders(mol, system) is not None

    for i, what, by in tries:  # one alone
        if change(i, what, by):
            return
        change(i, what, -by)
    done: list[tuple[int, str, int]] = []
    for i, what, by in tries:  # or several, as a fused system may lack more than one; those that aren't needed go again
        done.append((i, what, by))
        if change(i, what, by):
            for j, w, step in done[:-1]:
                if not change(j, w, -step):
                    change(j, w, step)
            return
    for i, what, by in done:
        change(i, what, -by)


def guess_hydrogens(mol: Molecule) -> None:
    """Implicit hydrogens of atoms whose charges are known."""
    for a in mol.atoms:
        a.impl_h = 0
    settled = Ledger(mol).settled.tolist()
    for i, a in enumerate(mol.atoms):
        a.impl_h = _room(a.z, a.fcharge, settled[i])
    balance_rings(mol, hydrogens=True, charges=False)


def guess_charges_and_hydrogens(mol: Molecule) -> None:
    """Charges only where there are more bonds than any usual valence has, and on bare metal and halogen atoms; hydrogens elsewhere."""
    for a in mol.atoms:
        a.fcharge = a.impl_h = 0
    charge_nitro(mol)
    settled = Ledger(mol).settled.tolist()
    alone = len(mol.atoms) > 1
    for i, a in enumerate(mol.atoms):
        most = max(USUAL.get(a.z, (99,)))
        if not a.fcharge and (settled[i] > most or settled[i] == 0 and alone and (a.z in (9, 17, 35, 53) or a.element.kind == "metal")):
            a.fcharge = charge_for(a.z, settled[i])
    settled = Ledger(mol).settled.tolist()
    for i, a in enumerate(mol.atoms):
        a.impl_h = _room(a.z, a.fcharge, settled[i])
    balance_rings(mol, hydrogens=True, charges=True)
