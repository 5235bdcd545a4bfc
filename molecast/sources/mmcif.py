"""Dictionary files as tables: long rows, categories, and molecules of coordinate blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cif
from ..functions.elements import by_symbol
from ..functions.kernels import map_rows
from ..functions.molecule import DOUBLE, QUADRUPLE, SINGLE, TRIPLE, Atom, Molecule

LONG = "block string, frame string, table_idx int, row_idx int, key string, value string, value_type int"
BOND_ORDERS = {"sing": SINGLE, "doub": DOUBLE, "trip": TRIPLE, "quad": QUADRUPLE}


def long_rows(df: DataFrame, column: str = "value", keep: str = "") -> DataFrame:
    """A row for each value of the files in a text column."""
    names, fields = [x.split()[0] for x in keep.split(", ") if x], [x.split()[0] for x in LONG.split(", ")]

    def kernel(row: dict) -> Iterator[dict]:
        own = {n: row[n] for n in names}
        for values in cif.long_rows(row[column] or ""):
            yield {**own, **dict(zip(fields, values, strict=True))}

    return map_rows(df.select(*names, column), kernel, ", ".join(x for x in (keep, LONG) if x))


def nullable(df: DataFrame) -> DataFrame:
    """Both kinds of null become null."""
    return df.withColumn("value", F.when(F.col("value_type") < cif.UNKNOWN, F.col("value")))


def category(df: DataFrame, prefix: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """The rows of one category, its attributes as columns."""
    by = by or ["block", "frame"]
    own = nullable(df).filter(F.col("key").startswith(prefix + ".")).withColumn("attr", F.split("key", r"\.", 2)[1])
    return own.groupBy(*by, "table_idx", "row_idx").pivot("attr", columns).agg(F.first("value"))


def as_dict(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """category to its rows as maps of attribute to value; null for both kinds of null."""
    by = by or ["block", "frame"]
    parts = F.split("key", r"\.", 2)
    own = nullable(df).select(*by, parts[0].alias("category"), F.coalesce(F.get(parts, 1), F.lit("")).alias("attr"), "table_idx", "row_idx", "value")
    rows = own.groupBy(*by, "category", "table_idx", "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "value")))).alias("row"))
    return rows.groupBy(*by, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "row_idx", F.to_json("row").alias("row")))), lambda r: r["row"]).alias("rows"))


def prefix_search_first(df: DataFrame, prefix: str) -> DataFrame:
    """The first key with the prefix in each frame, and its table."""
    return df.filter(F.col("key").startswith(prefix)).groupBy("block", "frame").agg(F.min(F.struct("key", "table_idx")).alias("m")).select("block", "frame", "m.key", "m.table_idx")


def _columns(frame: cif.Frame, name: str) -> list[dict[str, str | None]]:
    """The rows of a category, over the tables that hold it; as many as the shortest has."""
    cols: dict[str, list] = {}
    for keys, rows in frame.tables:
        for i, key in enumerate(keys):
            if key.lower().startswith(f"_{name}."):
                cols[key.split(".", 1)[1]] = [v if kind < cif.UNKNOWN else None for v, kind in (r[i] for r in rows)]
    n = min(map(len, cols.values()), default=0)
    return [{k: v[i] for k, v in cols.items()} for i in range(n)]


def _pick(rows: list[dict], auth: str, label: str) -> str:
    return auth if rows and auth in rows[0] else label


def frame_molecules(frame: cif.Frame) -> Iterator[Molecule]:
    """A molecule for each model of a block with coordinates; rows that can't be read are left out."""
    atoms = _columns(frame, "atom_site")
    both = atoms and {"auth_seq_id", "auth_asym_id"} <= atoms[0].keys()
    seq, asym = ("auth_seq_id", "auth_asym_id") if both else ("label_seq_id", "label_asym_id")
    comp, name = _pick(atoms, "label_comp_id", "auth_comp_id"), _pick(atoms, "label_atom_id", "auth_atom_id")
    models: dict[str, dict] = {}
    for row in atoms:
        try:
            site = (float(row.get("occupancy") or 1), [float(row.get(f"Cartn_{c}") or 0) for c in "xyz"], row.get("label_alt_id") or "")
        except ValueError:
            continue
        key = (row.get(asym) or "", row.get(seq) or "", row.get("pdbx_PDB_ins_code") or "", row.get(name) or "")
        model = models.setdefault(row.get("pdbx_PDB_model_num") or "1", {})
        if key in model and model[key]["comp"] != row.get(comp):
            continue
        model.setdefault(key, {"comp": row.get(comp) or "", "symbol": row.get("type_symbol") or "", "charge": row.get("pdbx_formal_charge"), "sites": []})["sites"].append(site)
    links = []
    for row in _columns(frame, "struct_conn"):
        if (row.get("conn_type_id") or "covale") in ("covale", "disulf"):
            ends = []
            for p in ("ptnr1", "ptnr2"):
                side = "auth" if both else "label"
                ends.append((row.get(f"{p}_{side}_asym_id") or "", row.get(f"{p}_{side}_seq_id") or "", row.get(f"pdbx_{p}_PDB_ins_code") or "", row.get(f"{p}_label_atom_id") or ""))
            order = (row.get("value_order") or row.get("pdbx_value_order") or "sing").lower()
            links.append((*ends, BOND_ORDERS.get(order, SINGLE)))
    for number, model in models.items():
        mol, place = Molecule(), {}
        mol.name, mol.props["model"] = frame.name, number
        residues: dict[tuple, dict] = {}
        for key, a in model.items():
            e = by_symbol().get(a["symbol"].capitalize())
            i = place[key] = mol.add_atom(Atom(e.z if e else 0, fcharge=int(a["charge"] or 0), name=key[3]))
            sub = residues.setdefault(key[:3], {"name": a["comp"], "id": int(key[1]) if key[1].lstrip("-").isdigit() else 0, "category": 1, "atom_ids": [], "props": {"chain": key[0], "icode": key[2]}})
            sub["atom_ids"].append(i)
        for a, b, order in links:
            if a in place and b in place and a != b:
                mol.add_bond(place[a], place[b], order)
        letters = sorted({s[2] for a in model.values() for s in a["sites"]} - {""}) or [""]
        for letter in letters:
            mol.confs.append(np.array([(next((s for s in a["sites"] if s[2] == letter), None) or max(a["sites"], key=lambda s: s[0]))[1] for a in model.values()]))
        mol.subs = list(residues.values())
        for chain in dict.fromkeys(k[0] for k in residues):
            mol.subs.append({"name": chain, "id": 0, "category": 2, "atom_ids": [i for k, s in residues.items() if k[0] == chain for i in s["atom_ids"]], "props": {}})
        yield mol.finish()
