"""Substructures of a molecule column, as expressions: what they hold, and the column with them changed.

A substructure is an entry of ``subs``: a name, an id, a category, the ids of its atoms, and
properties. Its bonds are those between its atoms, so they follow by themselves. Places
count from 0; a place that isn't there gives null, or changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def substructure(mol: Column, at: int | Column) -> Column:
    return F.get(mol["subs"], at if isinstance(at, Column) else F.lit(at))


def atoms(mol: Column, at: int | Column) -> Column:
    """The atoms of a substructure, in its own order."""
    return F.transform(substructure(mol, at)["atom_ids"], lambda i: F.get(mol["atoms"], i))


def bonds(mol: Column, at: int | Column) -> Column:
    """The bonds between the atoms of a substructure."""
    ids = substructure(mol, at)["atom_ids"]
    return F.filter(mol["bonds"], lambda b: F.array_contains(ids, b["src"]) & F.array_contains(ids, b["dst"]))


def contains(mol: Column, at: int | Column, atom: int | Column) -> Column:
    return F.array_contains(substructure(mol, at)["atom_ids"], atom)


def contains_bond(mol: Column, at: int | Column, bond: int | Column) -> Column:
    b = F.get(mol["bonds"], bond if isinstance(bond, Column) else F.lit(bond))
    return contains(mol, at, b["src"]) & contains(mol, at, b["dst"])


def own_ids(mol: Column, at: int | Column, atom: Column) -> Column:
    """The place of a molecule's atom within a substructure, or null."""
    place = F.array_position(substructure(mol, at)["atom_ids"], atom)
    return F.when(place > 0, (place - 1).cast("int"))


def holders(mol: Column, atom: int | Column) -> Column:
    """Places of the substructures that hold an atom."""
    every = F.transform(mol["subs"], lambda s, i: F.when(F.array_contains(s["atom_ids"], atom), i))
    return F.filter(every, lambda i: i.isNotNull())


def coordinates(mol: Column, at: int | Column, conf: int = 0) -> Column:
    """x, y, z of a substructure's atoms in a conformer, one after another."""
    xyz = F.get(mol["confs"], F.lit(conf))
    return F.flatten(F.transform(substructure(mol, at)["atom_ids"], lambda i: F.slice(xyz, 3 * i + 1, F.lit(3))))


def by_category(mol: Column, category: int) -> Column:
    return F.filter(mol["subs"], lambda s: s["category"] == category)


def by_name(mol: Column, name: str) -> Column:
    return F.filter(mol["subs"], lambda s: s["name"] == name)


# changes: each gives the molecule column anew


def _changed(mol: Column, at: int, change: Callable[[Column], Column]) -> Column:
    return mol.withField("subs", F.transform(mol["subs"], lambda s, i: F.when(i == at, change(s)).otherwise(s)))


def with_field(mol: Column, at: int, **fields: object) -> Column:
    """Another name, id, category or props."""
    def change(s: Column) -> Column:
        for name, value in fields.items():
            s = s.withField(name, value if isinstance(value, Column) else F.lit(value))
        return s

    return _changed(mol, at, change)


def add_atoms(mol: Column, at: int, ids: Column) -> Column:
    """Atoms that it hasn't and the molecule has come last."""
    return _changed(mol, at, lambda s: s.withField("atom_ids", F.concat(s["atom_ids"], F.filter(F.array_distinct(ids), lambda i: ~F.array_contains(s["atom_ids"], i) & (i >= 0) & (i < F.size(mol["atoms"]))))))


def add_bonds(mol: Column, at: int, places: Column) -> Column:
    """The ends of these bonds come into the substructure, and with them the bonds."""
    ends = F.flatten(F.transform(places, lambda e: F.array(F.get(mol["bonds"], e)["src"], F.get(mol["bonds"], e)["dst"])))
    return add_atoms(mol, at, F.filter(ends, lambda i: i.isNotNull()))


def erase_atoms(mol: Column, at: int, ids: Column) -> Column:
    return _changed(mol, at, lambda s: s.withField("atom_ids", F.filter(s["atom_ids"], lambda i: ~F.array_contains(ids, i))))


def clear_atoms(mol: Column, at: int) -> Column:
    return _changed(mol, at, lambda s: s.withField("atom_ids", F.slice(s["atom_ids"], 1, 0)))


def sorted_atoms(mol: Column, at: int) -> Column:
    return _changed(mol, at, lambda s: s.withField("atom_ids", F.array_sort(s["atom_ids"])))


def new(ids: Column, name: str = "", ident: int = 0, category: int = 0) -> Column:
    """A substructure of these atoms."""
    props = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), F.lit(ident).alias("id"), F.lit(category).alias("category"), ids.cast("array<int>").alias("atom_ids"), props.alias("props"))


def append(mol: Column, sub: Column) -> Column:
    return mol.withField("subs", F.concat(mol["subs"], F.array(sub)))


def insert(mol: Column, at: int, sub: Column) -> Column:
    """Before the one at this place; beyond the end, last."""
    return mol.withField("subs", F.concat(F.slice(mol["subs"], 1, at), F.array(sub), F.slice(mol["subs"], at + 1, F.greatest(F.size(mol["subs"]), F.lit(1)))))


def remove(mol: Column, at: int) -> Column:
    kept = F.transform(mol["subs"], lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return mol.withField("subs", F.transform(F.filter(kept, lambda x: x["i"] != at), lambda x: x["s"]))


def clear(mol: Column) -> Column:
    return mol.withField("subs", F.slice(mol["subs"], 1, 0))
