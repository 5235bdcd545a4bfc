"""Reading and writing molecules: text formats to rows with a nested molecule, and back.

Files are read by Spark's own text readers, so that any store it knows works. Line
formats and records with a delimiter are split by it, so that a large file is read by
many tasks; formats whose records span what the reader can't split are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cif, mol2, pdb, sdf, smiles
from ..functions.kernels import map_rows
from ..functions.molecule import SCHEMA, Molecule, from_row, hide_hydrogens, to_row
from ..functions.perception import sanitize

#: Format name to (how files are split: None for whole files, or the separator; text to molecules).
READERS: dict[str, tuple[str | None, Callable[[str], Iterator[Molecule]]]] = {}
WRITERS: dict[str, Callable[[Molecule], str]] = {}


def register_reader(names: list[str], separator: str | None, parse: Callable[[str], Iterator[Molecule]]) -> None:
    """A name that is registered again means the new reader."""
    for name in names:
        READERS[name] = separator, parse


def _mol2(text: str) -> Iterator[Molecule]:
    for record in mol2.records(text if text.lstrip().startswith((mol2.TAG, "#")) else f"{mol2.TAG}MOLECULE" + text):
        yield mol2.read_mol2(record)


def _pdb(text: str) -> Iterator[Molecule]:
    for _, lines in pdb.models(text):
        yield pdb.read_pdb(lines)


def _cif(text: str) -> Iterator[Molecule]:
    from .mmcif import frame_molecules

    for block in cif.read_blocks(text):
        yield from frame_molecules(block)


register_reader(["smi", "smiles"], "\n", lambda t: (smiles.read_smiles(x) for x in t.splitlines() if x.strip()))
register_reader(["sdf", "mol"], "$$$$\n", lambda t: (sdf.read_sdf(r) for r in sdf.records(t)))
register_reader(["mol2"], "@<TRIPOS>MOLECULE", _mol2)
register_reader(["pdb"], None, _pdb)
register_reader(["cif", "mmcif"], None, _cif)
WRITERS |= {"smi": smiles.write_smiles, "smiles": smiles.write_smiles, "sdf": sdf.write_sdf, "mol": sdf.write_sdf, "mol2": mol2.write_mol2, "pdb": pdb.write_pdb}

OUT = f"idx int, mol {SCHEMA}"


def parse_column(df: DataFrame, fmt: str, column: str, keep: str = "", clean: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """The molecules of a text column: keep (a DDL list of columns), idx within the text, mol.

    PERMISSIVE gives a row with mol.error for what can't be read or sanitised,
    DROPMALFORMED leaves it out, FAILFAST raises.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"no mode {mode}")
    parse, names = READERS[fmt][1], [x.split()[0] for x in keep.split(", ") if x]

    def kernel(row: dict) -> Iterator[dict]:
        own, stream, i = {n: row[n] for n in names}, iter(()), -1
        try:
            stream = iter(parse(row[column] or ""))
        except ValueError as e:
            if mode == "FAILFAST":
                raise
            if mode == "PERMISSIVE":
                yield {**own, "idx": 0, "mol": _failed(str(e))}
            return
        while True:
            i += 1
            try:
                mol = next(stream)
                mol.error = sanitize(mol) if clean and fmt not in ("pdb", "cif", "mmcif") else None
                if mol.error and mode == "FAILFAST":
                    raise ValueError(mol.error)
            except StopIteration:
                return
            except ValueError as e:
                if mode == "FAILFAST":
                    raise
                if mode == "PERMISSIVE":
                    yield {**own, "idx": i, "mol": _failed(str(e))}
                return
            if not mol.error or mode == "PERMISSIVE":
                yield {**own, "idx": i, "mol": to_row(mol)}

    return map_rows(df, kernel, ", ".join(x for x in (keep, OUT) if x), [*names, column])


def _failed(text: str) -> dict:
    out = to_row(Molecule())
    out["error"] = text
    return out


def text_rows(spark: SparkSession, fmt: str, path: str, stream: bool = False) -> DataFrame:
    """value: the records of the files, as the reader splits them."""
    separator, reader = READERS[fmt][0], spark.readStream if stream else spark.read
    lines = reader.text(path, wholetext=True) if separator is None else reader.text(path, lineSep=separator)
    return lines.filter(F.length(F.trim("value")) > 0)


def read_molecules(spark: SparkSession, path: str, fmt: str | None = None, clean: bool = True, mode: str = "PERMISSIVE", stream: bool = False) -> DataFrame:
    """The molecules of files, in a batch or as they arrive; the format is the extension's unless given."""
    fmt = fmt or re.sub(r".*\.", "", path).lower()
    if fmt not in READERS:
        raise ValueError(f"no reader for {fmt!r}")
    return parse_column(text_rows(spark, fmt, path, stream), fmt, "value", "", clean, mode)


def format_column(df: DataFrame, fmt: str, column: str = "mol", keep: str = "", out: str = "value") -> DataFrame:
    """The text of each molecule."""
    write, names = WRITERS[fmt], [x.split()[0] for x in keep.split(", ") if x]

    def kernel(row: dict) -> Iterator[dict]:
        yield {**{n: row[n] for n in names}, out: write(from_row(row[column]))}

    return map_rows(df, kernel, ", ".join(x for x in (keep, f"{out} string") if x), [*names, column])


def write_molecules(df: DataFrame, path: str, fmt: str, column: str = "mol") -> None:
    """Text files of the molecules, one or more by partition."""
    df = format_column(df, fmt, column)
    (df.select(F.rtrim(F.col("value"), F.lit("\n")).alias("value")) if fmt != "smi" else df).write.text(path)


def conceal_hydrogens(df: DataFrame, column: str = "mol", keep: str = "") -> DataFrame:
    """Plain hydrogen atoms become counts of their neighbours."""
    names = [x.split()[0] for x in keep.split(", ") if x]

    def kernel(row: dict) -> Iterator[dict]:
        yield {**{n: row[n] for n in names}, "mol": to_row(hide_hydrogens(from_row(row[column])))}

    return map_rows(df, kernel, ", ".join(x for x in (keep, f"mol {SCHEMA}") if x), [*names, column])
