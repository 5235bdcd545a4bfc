"""Fixed-width coordinate files: models, sites, residues, chains, and writing."""

from __future__ import annotations

import numpy as np

from .elements import by_symbol
from .molecule import SINGLE, Atom, Molecule

#: Residues that are written as ATOM; others are HETATM.
STANDARD = set("ALA ARG ASN ASP ASX CYS GLN GLU GLX GLY HIS ILE LEU LYS MET PHE PRO PYL SEC SER THR TRP TYR VAL A C G U I DA DC DG DT DI".split())


#: Records that end a file: what is said after the coordinates of all models.
FOOTERS = ("CONECT", "MASTER", "END")


def frame(text: str) -> tuple[list[str], list[tuple[int, list[str]]], list[str]]:
    """Header lines, (number, lines) of each model, and footer lines. A file without model records is one model; the footer is what ends it, from the last line back to the first that isn't of a footer's kind."""
    lines = text.splitlines()
    stop = len(lines)
    while stop and (not lines[stop - 1].strip() or lines[stop - 1][:6].rstrip() in FOOTERS):
        stop -= 1
    body, foot = lines[:stop], [x for x in lines[stop:] if x.strip()]
    starts = [i for i, x in enumerate(body) if x[:6].rstrip() == "MODEL"]
    if not starts:
        first = next((i for i, x in enumerate(body) if x[:6] in ("ATOM  ", "HETATM")), len(body))
        return body[:first], [(1, body[first:])], foot
    out = []
    for k, i in enumerate(starts):
        after = starts[k + 1] if k + 1 < len(starts) else len(body)
        end = next((e for e in range(i + 1, after) if body[e].startswith("ENDMDL")), after)
        number = body[i][10:14].strip()
        out.append((int(number) if number.isdigit() else k + 1, body[i + 1 : end]))
    last = next((e for e in range(starts[-1] + 1, len(body)) if body[e].startswith("ENDMDL")), len(body))
    return body[: starts[0]], out, [*body[last + 1 :], *foot]


def models(text: str):
    """(number, lines) of each model: the header and the footer go to each."""
    head, parts, foot = frame(text)
    for number, lines in parts:
        yield number, [*head, *lines, *foot]


def _number(text: str, default: float = 0.0) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def guess_element(name: str, symbol: str) -> int:
    """By the element columns, else by the name's place: symbols end in its second column."""
    for text in (symbol.strip(), name[:2].strip() if not name[:1].isdigit() else name[1:2], name.strip().lstrip("0123456789")[:1]):
        e = by_symbol().get(text.capitalize())
        if e is not None and text:
            return e.z
    return 0


def atom_rows(lines: list[str]):
    """A dict for each valid ATOM or HETATM line; lines under 47 characters are left out."""
    for line in lines:
        if line.startswith(("ATOM  ", "HETATM")) and len(line) >= 47:
            line = line.ljust(80)
            try:
                xyz = [float(line[k : k + 8]) for k in (30, 38, 46)]
            except ValueError:
                continue
            charge = line[78:80].strip()
            yield {
                "serial": line[6:11].strip(), "name": line[12:16].strip(), "altloc": line[16].strip(), "res_name": line[17:20].strip(), "chain_id": line[21].strip(), "res_seq": int(_number(line[22:26])), "ins_code": line[26].strip(),
                "x": xyz[0], "y": xyz[1], "z": xyz[2], "occupancy": _number(line[54:60], 1.0), "tempfactor": _number(line[60:66]), "element": guess_element(line[12:16], line[76:78]),
                "formal_charge": int(charge[0]) * (-1 if charge[1:] == "-" else 1) if charge[:1].isdigit() else 0, "hetero": line.startswith("HETATM"),
            }


def read_model(lines: list[str]) -> dict:
    """Atoms with their alternate sites (by falling occupancy), residues and chains, in order of appearance."""
    atoms: dict[tuple, dict] = {}
    residues: dict[tuple, dict] = {}
    chains: dict[str, dict] = {}
    for row in atom_rows(lines):
        rid = (row["chain_id"], row["res_seq"], row["ins_code"])
        res = residues.setdefault(rid, {"id": rid, "name": row["res_name"], "atom_idxs": []})
        if res["name"] != row["res_name"]:
            continue
        key = (*rid, row["name"])
        site = {k: row[k] for k in ("altloc", "x", "y", "z", "occupancy", "tempfactor")}
        if key not in atoms:
            res["atom_idxs"].append(len(atoms))
            atoms[key] = {"res_id": rid, **{k: row[k] for k in ("serial", "name", "element", "formal_charge", "hetero")}, "sites": [site]}
        elif all(s["altloc"] != site["altloc"] for s in atoms[key]["sites"]):
            atoms[key]["sites"].append(site)
    for a in atoms.values():
        a["sites"].sort(key=lambda s: -s["occupancy"])
    for k, rid in enumerate(residues):
        chains.setdefault(rid[0], {"id": rid[0], "res_idxs": []})["res_idxs"].append(k)
    return {"atoms": list(atoms.values()), "residues": list(residues.values()), "chains": list(chains.values())}


def read_pdb(lines: list[str], name: str = "") -> Molecule:
    """A molecule: a conformer for each alternate letter (atoms without it at their best site), bonds from CONECT, residues and chains as substructures."""
    model, mol, serial = read_model(lines), Molecule(), {}
    mol.name = name or next((x[62:66].strip() for x in lines if x.startswith("HEADER")), "")
    for i, a in enumerate(model["atoms"]):
        mol.add_atom(Atom(a["element"], fcharge=a["formal_charge"], name=a["name"], props={"serial": a["serial"]}))
        serial[a["serial"]] = i
    for line in lines:
        if line.startswith("CONECT"):
            nums = [line[k : k + 5].strip() for k in range(6, min(len(line), 31), 5)]
            for n in nums[1:]:
                if nums[0] in serial and n in serial and serial[n] != serial[nums[0]]:
                    mol.add_bond(serial[nums[0]], serial[n], SINGLE)
    letters = sorted({s["altloc"] for a in model["atoms"] for s in a["sites"]} - {""}) or [""]
    for letter in letters if model["atoms"] else []:
        sites = [next((s for s in a["sites"] if s["altloc"] == letter), a["sites"][0]) for a in model["atoms"]]
        mol.confs.append(np.array([[s["x"], s["y"], s["z"]] for s in sites]))
    for r in model["residues"]:
        mol.subs.append({"name": r["name"], "id": r["id"][1], "category": 1, "atom_ids": r["atom_idxs"], "props": {"chain": r["id"][0], "icode": r["id"][2]}})
    for c in model["chains"]:
        mol.subs.append({"name": c["id"], "id": 0, "category": 2, "atom_ids": sorted(i for k in c["res_idxs"] for i in model["residues"][k]["atom_idxs"]), "props": {}})
    return mol.finish()


def atom_line(serial: int, name: str, res_name: str, chain: str, res_seq: int, xyz, symbol: str, icode: str = "", occupancy: float = 1.0, temp: float = 0.0, charge: int = 0) -> str:
    """One ATOM or HETATM line."""
    if any(not -999.999 <= v <= 9999.999 for v in xyz):
        raise ValueError("coordinates are out of range")
    kind = "ATOM  " if res_name in STANDARD else "HETATM"
    label = name if len(name) > 3 or len(symbol) > 1 else f" {name}"
    sign = "" if not charge else f"{abs(charge)}{'+' if charge > 0 else '-'}"
    return f"{kind}{serial:5d} {label:<4} {res_name:>3} {chain[:1] or ' '}{res_seq:4d}{icode[:1] or ' '}   {xyz[0]:8.3f}{xyz[1]:8.3f}{xyz[2]:8.3f}{occupancy:6.2f}{temp:6.2f}          {symbol.upper():>2}{sign}"


def write_pdb(mol: Molecule, conf: int | None = None) -> str:
    """Models of one conformer, or of all; names that repeat within a residue are numbered."""
    confs = mol.confs if conf is None else [mol.confs[conf]]
    of: dict[int, dict] = {i: s for s in mol.subs if s["category"] == 1 for i in s["atom_ids"]}
    chain = {i: s["name"] for s in mol.subs if s["category"] == 2 for i in s["atom_ids"]}
    names, count = [], {}
    for i, a in enumerate(mol.atoms):
        base = a.name or a.element.symbol.upper()
        k = count[id(of.get(i)), base] = count.get((id(of.get(i)), base), 0) + 1
        names.append((base, k, id(of.get(i))))
    names = [b if count[r, b] == 1 else f"{b}{k}" for b, k, r in names]
    out = []
    for m, c in enumerate(confs):
        if m >= 9999:
            raise ValueError("a file holds at most 9999 models")
        if len(confs) > 1:
            out.append(f"MODEL     {m + 1:4d}")
        for i, (a, xyz) in enumerate(zip(mol.atoms, c, strict=True)):
            res = of.get(i) or {"name": "UNK", "id": 1, "props": {}}
            out.append(atom_line(i + 1, names[i], res["name"][:3], chain.get(i, res.get("props", {}).get("chain", "A")), res["id"], xyz, a.element.symbol if a.z else "", res.get("props", {}).get("icode", ""), charge=a.fcharge))
        for i in range(len(mol.atoms)):
            near = sorted(j + 1 for j, _ in mol.near[i])
            out += [f"CONECT{i + 1:5d}" + "".join(f"{j:5d}" for j in near[k : k + 4]) for k in range(0, len(near), 4)]
        if len(confs) > 1:
            out.append("ENDMDL")
    return "\n".join([*out, "END"]) + "\n"
