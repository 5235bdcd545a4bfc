"""Functions for SQL text: register(spark) adds them to a session.

Scalar functions take whole Arrow batches; table functions give rows for a text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import cif
from .descriptors import gasteiger, surface_area
from .molecule import relevant_rings, smallest_rings
from .perception import sanitize
from .smiles import SmilesError, read_smiles, write_smiles

SUMMARY = "name string, heavy_atoms int, bonds int, hydrogens int, charge int, rings int, aromatic_atoms int, weight double, error string"


def _parsed(line: str | None):
    mol = read_smiles(line or "")
    return mol, sanitize(mol)


def _summary(line: str | None) -> tuple:
    try:
        mol, error = _parsed(line)
    except SmilesError as e:
        return (None,) * 8 + (str(e),)
    return mol.name, mol.heavy_atoms(), len(mol.bonds), sum(a.impl_h for a in mol.atoms), sum(a.fcharge for a in mol.atoms), mol.num_sssr, sum(a.aromatic for a in mol.atoms), mol.weight(), error


def smiles_summary(lines: pd.Series) -> pd.DataFrame:
    """Counts of a line's molecule."""
    return pd.DataFrame([_summary(x) for x in lines], columns=[x.split()[0] for x in SUMMARY.split(", ")])


def _rewritten(line: str | None) -> str | None:
    try:
        return write_smiles(_parsed(line)[0])
    except SmilesError:
        return None


def smiles_rewrite(lines: pd.Series) -> pd.Series:
    """The line as this library writes it; null if it can't be read."""
    return lines.map(_rewritten)


def _charges(line: str | None) -> list[float] | None:
    try:
        mol, _ = _parsed(line)
    except SmilesError:
        return None
    return None if gasteiger(mol) else [a.pcharge for a in mol.atoms]


def smiles_charges(lines: pd.Series) -> pd.Series:
    """Partial charges of the atoms."""
    return lines.map(_charges)


def sphere_areas(points: pd.Series, radii: pd.Series) -> pd.Series:
    """Touchable area of each sphere; points are x, y, z in a row."""
    return pd.Series([surface_area(p.reshape(-1, 3), r).tolist() for p, r in zip(points, radii, strict=True)])


class CifRows:
    """A row for each value of a dictionary file's text."""

    def eval(self, text: str):
        yield from cif.long_rows(text or "")


class SmilesRings:
    """The atoms of a molecule's rings: one minimum basis, or all relevant ones."""

    def eval(self, line: str, relevant: bool):
        mol, _ = _parsed(line)
        for k, ring in enumerate((relevant_rings if relevant else smallest_rings)(mol)):
            for a in ring:
                yield k, len(ring), a


def register(spark: SparkSession) -> None:
    """Types are given here, as parsing them needs a session, which workers don't have."""
    for f, kind in ((smiles_summary, SUMMARY), (smiles_rewrite, "string"), (smiles_charges, "array<double>"), (sphere_areas, "array<double>")):
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
    spark.udtf.register("cif_rows", F.udtf(CifRows, returnType="block string, frame string, table_idx int, row_idx int, key string, value string, value_type int"))
    spark.udtf.register("smiles_rings", F.udtf(SmilesRings, returnType="ring int, size int, atom int"))
