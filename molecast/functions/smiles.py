"""Line notation: reading and writing molecules as SMILES."""

from __future__ import annotations

import re

from .elements import by_symbol
from .molecule import AROMATIC, DOUBLE, QUADRUPLE, SINGLE, TRIPLE, Atom, Molecule
from .perception import bond_order_sums

BRACKET = re.compile(r"\[(\d+)?([A-Z][a-z]?|[bcnops]|se|as|\*)(@{0,2})(H\d*)?(\+\+?|--?|[+-]\d+|\+\d+)?(?::(\d+))?\]")
ORGANIC = re.compile(r"Cl|Br|[BCNOFPSI*]|[bcnops]")
ORDERS = {"-": SINGLE, "=": DOUBLE, "#": TRIPLE, "$": QUADRUPLE, ":": AROMATIC, "/": SINGLE, "\\": SINGLE}
#: Bonds that an atom without brackets is filled up to with hydrogens.
FILL = {5: (3,), 6: (4,), 7: (3,), 8: (2,), 15: (3, 5), 16: (2, 4, 6)}


class SmilesError(ValueError):
    """The text isn't valid SMILES."""


def _charge(text: str | None) -> int:
    if not text:
        return 0
    sign = 1 if text[0] == "+" else -1
    return sign * (int(text[1:]) if text[1:].isdigit() else len(text))


def _atom(symbol: str) -> Atom:
    if symbol == "*":
        return Atom(0)
    element = by_symbol().get(symbol.capitalize() if symbol.islower() else symbol)
    if element is None:
        raise SmilesError(f"no element {symbol}")
    return Atom(element.z, aromatic=symbol.islower())


def read_smiles(line: str) -> Molecule:
    """The molecule of a line; what follows the first blank is its name."""
    text, _, name = line.strip().partition(" ") if "\t" not in line else line.strip().replace("\t", " ", 1).partition(" ")
    mol = Molecule()
    at, last, stack, bond = 0, None, [], None
    open_rings: dict[int, tuple[int, str | None, int]] = {}
    plain, loose, slashes, turns = [], [], {}, {}

    def link(a: int, b: int, how: str | None) -> int:
        order = ORDERS[how] if how else SINGLE
        if how is None and mol.atoms[a].aromatic and mol.atoms[b].aromatic:
            order = AROMATIC
        i, new = mol.add_bond(a, b, order, aromatic=order == AROMATIC)
        if not new:
            raise SmilesError(f"atoms {a} and {b} are bonded twice")
        if how is None and order == AROMATIC:
            loose.append(i)
        return i

    def place(atom: Atom) -> None:
        nonlocal last, bond
        new = mol.add_atom(atom)
        turns[new] = []
        if last is not None and bond != ".":
            link(last, new, bond)
            if bond in ("/", "\\"):
                slashes[last, new] = bond
            turns[last].append(new)
            turns[new].append(last)
        if atom.impl_h:
            turns[new].append(-1)
        last, bond = new, None

    while at < len(text):
        c = text[at]
        if c == "[":
            got = BRACKET.match(text, at)
            if not got:
                raise SmilesError(f"a bracket isn't valid at {at}")
            iso, symbol, chiral, h, charge, _ = got.groups()
            atom = _atom(symbol)
            atom.isotope, atom.fcharge = int(iso or 0), _charge(charge)
            atom.impl_h = 0 if not h else int(h[1:] or 1)
            atom.chirality = {"": 0, "@": 2, "@@": 1}[chiral]
            place(atom)
            at = got.end()
            continue
        if got := ORGANIC.match(text, at):
            place(_atom(got[0]))
            plain.append(last)
            at = got.end()
            continue
        if c == "(":
            if last is None:
                raise SmilesError("a branch starts without an atom")
            stack.append(last)
        elif c == ")":
            if not stack:
                raise SmilesError("a branch ends that didn't start")
            last, bond = stack.pop(), None
        elif c in ORDERS or c == ".":
            if bond is not None or last is None:
                raise SmilesError(f"a bond isn't valid at {at}")
            bond = c
        elif c.isdigit() or c == "%":
            number = text[at + 1 : at + 3] if c == "%" else c
            if last is None or not number.isdigit() or c == "%" and len(number) < 2:
                raise SmilesError(f"a ring number isn't valid at {at}")
            at += 2 * (c == "%")
            n = int(number)
            if n in open_rings:
                other, how, spot = open_rings.pop(n)
                if bond and how and ORDERS[bond] != ORDERS[how]:
                    raise SmilesError(f"ring {n} has two kinds of bond")
                if other == last:
                    raise SmilesError(f"ring {n} closes on its own atom")
                link(other, last, how or bond)
                if how in ("/", "\\"):
                    slashes[other, last] = how
                elif bond in ("/", "\\"):
                    slashes[last, other] = bond
                turns[other][spot] = last
                turns[last].append(other)
            else:
                open_rings[n] = last, bond, len(turns[last])
                turns[last].append(None)
            bond = None
        else:
            raise SmilesError(f"{c!r} isn't valid at {at}")
        at += 1
    if stack or open_rings or bond:
        raise SmilesError("a branch, ring or bond is left open")
    mol.name = name.strip()
    mol.finish()
    for i in loose:  # between aromatic atoms, but in no ring
        if not mol.bonds[i].ring:
            mol.bonds[i].bo, mol.bonds[i].aromatic = SINGLE, False
    _read_geometry(mol, slashes)
    totals = bond_order_sums(mol, 0)
    for i in plain:
        a, total = mol.atoms[i], totals[i]
        if a.z:
            fill = FILL.get(a.z, (1,))
            a.impl_h = max(0, next((v for v in fill if v >= total), fill[-1]) - total)
    for i, a in enumerate(mol.atoms):
        if a.chirality and len(mol.near[i]) >= 3 and a.impl_h <= 1 and len(turns[i]) == 4:
            want = [j for j, _ in mol.near[i]] + ([-1] if a.impl_h else [])
            if _odd([want.index(j) for j in turns[i]]):
                a.chirality = 3 - a.chirality
    return mol


def _odd(order: list[int]) -> bool:
    return sum(order[i] > order[j] for j in range(len(order)) for i in range(j)) % 2 == 1


def _read_geometry(mol: Molecule, slashes: dict[tuple[int, int], str]) -> None:
    """Configuration of double bonds from the slashes at both ends; of each atom's, those of its lowest neighbour tell."""
    marks: dict[int, list[tuple[int, bool]]] = {}
    for (a, b), mark in slashes.items():
        marks.setdefault(a, []).append((b, mark == "/"))
        marks.setdefault(b, []).append((a, mark != "/"))

    def side(atom: int, across: int) -> bool | None:
        mine = [(n, up) for n, up in marks.get(atom, ()) if n != across]
        if not mine or len(mine) > 2:
            return None
        if len(mine) == 2 and mine[0][1] == mine[1][1]:
            raise SmilesError(f"the marks at atom {atom} contradict each other")
        first = min(n for n, _ in mol.near[atom] if n != across)
        n, up = mine[0]
        return up if n == first else not up

    for b in mol.bonds:
        if b.bo == DOUBLE:
            s, d = side(b.src, b.dst), side(b.dst, b.src)
            if s is not None and d is not None:
                b.config = 1 if s != d else 2


def write_smiles(mol: Molecule) -> str:
    """A line of one text for each fragment and the name; not canonical. Configurations of double bonds are written where the notation needs no more than one mark at an end."""
    out, number, seen, totals = [], {}, set(), bond_order_sums(mol, 0)
    closing: dict[int, list[int]] = {}
    order: list[int] = []
    tree: dict[int, list[tuple[int, int]]] = {}
    for start in range(len(mol.atoms)):
        if start in seen:
            continue
        stack = [(start, -1)]
        while stack:  # depth first; what leads back is a ring closure
            u, e = stack.pop()
            if u in seen:
                continue
            seen.add(u)
            order.append(u)
            if e >= 0:
                tree.setdefault(mol.bonds[e].other(u), []).append((u, e))
            stack += [(v, f) for v, f in reversed(mol.near[u]) if v not in seen]
    used = {e for kids in tree.values() for _, e in kids}
    place = {u: i for i, u in enumerate(order)}
    for i, b in enumerate(mol.bonds):
        if i not in used:
            for end in sorted((b.src, b.dst), key=place.get):
                closing.setdefault(end, []).append(i)
    free, marks = list(range(99, 0, -1)), _marks(mol, place)

    def bond(i: int, u: int, v: int) -> str:
        b = mol.bonds[i]
        if (mark := marks.get((u, v))) is not None:
            return "/" if mark else "\\"
        both = mol.atoms[u].aromatic and mol.atoms[v].aromatic
        return {SINGLE: "-" if both else "", DOUBLE: "=", TRIPLE: "#", QUADRUPLE: "$", AROMATIC: "" if both else ":"}.get(b.bo, "~")

    def atom(u: int, before: int | None, kids: list[int]) -> str:
        a = mol.atoms[u]
        symbol = "*" if a.z == 0 else a.element.symbol
        if a.aromatic and symbol in ("B", "C", "N", "O", "P", "S", "Se", "As"):
            symbol = symbol.lower()
        filled = None
        if a.z in FILL or a.z in (9, 17, 35, 53):
            total, fill = totals[u], FILL.get(a.z, (1,))
            filled = max(0, next((v for v in fill if v >= total), fill[-1]) - total)
        turn = ""
        if a.chirality:
            said = ([before] if before is not None else []) + ([-1] if a.impl_h else []) + kids
            want = [j for j, _ in mol.near[u]] + ([-1] if a.impl_h else [])
            clock = a.chirality
            if len(said) == 4 and sorted(said) == sorted(want) and _odd([want.index(j) for j in said]):
                clock = 3 - clock
            turn = "@@" if clock == 1 else "@"
        if not (a.isotope or a.fcharge or turn) and (a.z == 0 and not a.impl_h or filled == a.impl_h):
            return symbol
        charge = "" if not a.fcharge else f"{a.fcharge:+d}" if abs(a.fcharge) > 1 else "+" if a.fcharge > 0 else "-"
        h = "" if not a.impl_h else "H" if a.impl_h == 1 else f"H{a.impl_h}"
        return f"[{a.isotope or ''}{symbol}{turn}{h}{charge}]"

    def ring(i: int, u: int) -> str:
        if i in number:
            n = number.pop(i)
            free.append(n)
            free.sort(reverse=True)
            mark = ""
        else:
            if not free:
                raise ValueError("more than 99 rings are open at once")
            n = number[i] = free.pop()
            mark = bond(i, u, mol.bonds[i].other(u))
        return mark + (str(n) if n < 10 else f"%{n}")

    parts: list[str] = []
    for start in order:
        if any(start == v for kids in tree.values() for v, _ in kids):
            continue
        text: list[str] = []
        work: list = [(start, None, -1)]
        while work:
            item = work.pop()
            if isinstance(item, str):
                text.append(item)
                continue
            u, before, e = item
            kids, rings = tree.get(u, []), closing.get(u, [])
            text.append("" if e < 0 else bond(e, before, u))
            text.append(atom(u, before, [mol.bonds[i].other(u) for i in rings] + [v for v, _ in kids]))
            text += [ring(i, u) for i in rings]
            for k, (v, f) in reversed(list(enumerate(kids))):
                if k + 1 < len(kids):
                    work += [")", (v, u, f), "("]
                else:
                    work.append((v, u, f))
        parts.append("".join(text))
    out = ".".join(parts)
    return f"{out}\t{mol.name}" if mol.name else out


def _marks(mol: Molecule, place: dict[int, int]) -> dict[tuple[int, int], bool]:
    """Slashes (up?) by direction of writing, for the double bonds with a configuration; a bond that two of them would mark differently is left to the first."""
    up: dict[frozenset, tuple[int, bool]] = {}
    out: dict[tuple[int, int], bool] = {}
    for b in sorted((b for b in mol.bonds if b.config and b.bo == DOUBLE), key=lambda b: min(place[b.src], place[b.dst])):
        ends = []
        for atom, across in ((b.src, b.dst), (b.dst, b.src)):
            others = [n for n, e in mol.near[atom] if n != across and mol.bonds[e].bo == SINGLE]
            if not others:
                break
            first = min(n for n, _ in mol.near[atom] if n != across)
            pick = next((n for n in others if frozenset((atom, n)) in up), first if first in others else others[0])
            ends.append((atom, pick, pick == first))
        if len(ends) < 2:
            continue
        (a, p, pf), (c, q, qf) = ends

        def said(atom: int, n: int) -> bool | None:
            got = up.get(frozenset((atom, n)))
            return None if got is None else got[1] if got[0] == atom else not got[1]

        want = b.config == 1
        s, d = said(a, p), said(c, q)
        s = s if s is not None else (d if d is not None else True) != (want ^ (pf != qf)) if d is not None else True
        up.setdefault(frozenset((a, p)), (a, s))
        up.setdefault(frozenset((c, q)), (c, s != want if pf == qf else s == want))
    for pair, (atom, way) in up.items():
        n = next(x for x in pair if x != atom)
        out[atom, n], out[n, atom] = way, not way
    return out
