import math

import pytest

from molecast.llm.license_scan import TEMPLATES, LicenseModel, grams_of, licensed_lines, scan_licenses, words_of

from .helpers import docs

NEGATIVES = [f"some words about thing {i} and the other of it in a place with no meaning" for i in range(300)]


@pytest.fixture(scope="module")
def model():
    return LicenseModel(NEGATIVES)


def brute(model, text, least=0.5, confirm=0.6):
    table = {g: (v, inside) for g, v, inside in model.table}
    out = []
    for n, line in enumerate((text or "").split("\n")):
        grams = grams_of(words_of(line))
        z = [(model.bias[k] + sum(table[g][0][k] for g in grams if g in table)) / model.heat for k in range(len(model.families) + 1)]
        k = max(range(len(model.families)), key=lambda i: (z[i], -i))
        p = math.exp(z[k] - max(z)) / sum(math.exp(x - max(z)) for x in z)
        match = sum(k in table[g][1] for g in grams if g in table) / max(len(grams), 1)
        if p >= least and match >= confirm:
            out.append((n, model.families[k], round(p, 9), round(match, 9)))
    return out


def cases():
    rows = [(i, f"First line {i}.\n{t}\nlast") for i, t in enumerate(t for ts in TEMPLATES.values() for t in ts)]
    rows += [(100 + i, t) for i, t in enumerate(NEGATIVES[:20])]
    return [*rows, (200, None), (201, ""), (202, "a the of license"), (203, "The license of the driver is public and free"), (204, "Released under the MIT License.\nReleased under the MIT License."), (204, "x"), (None, "Licensed under CC BY-NC 4.0."), (205, "license " * 20000), (206, "Licenced   UNDER the apache licence; version 2.0")]


def test_equals_brute_force(spark, model):
    rows = cases()
    got = scan_licenses(docs(spark, rows, [("line_no", 1), ("family", "x"), ("w", 2)]), model)
    lines = sorted(((r.doc_id, [(x.line_no, x.family, round(x.probability, 9), round(x.match, 9)) for x in r.lines or ()]) for r in got.collect()), key=repr)
    assert lines == sorted(((i, brute(model, t)) for i, t in rows), key=repr)
    assert got.count() == len(rows) and got.filter("doc_id = 100").first().families == []


def test_templates_are_named_and_text_is_not(spark, model):
    wrong = [(t, k) for k, ts in TEMPLATES.items() for t in ts if [f for _, f, _, _ in brute(model, t)] != [k]]
    assert len(wrong) <= 2, wrong
    assert not any(brute(model, t) for t in NEGATIVES)


def test_empty_table(spark, model):
    assert scan_licenses(docs(spark, []), model).collect() == []
    assert scan_licenses(docs(spark, [(1, "x")])).first().families == []


def test_notices_within_longer_lines(spark, model):
    around = "the words of a page about thing 7 and the other of it"
    rows = [(i, f"{around} {t} {around} {around}") for i, t in enumerate(t for ts in TEMPLATES.values() for t in ts)]
    rows += [(100, "Copyright (c) 2021 Jane Doe. Released under the MIT License."), (101, f"{around} Released under the MIT License. {around} {around}. Licensed under the Apache License, Version 2.0. {around}")]
    rows += [(102, f"{around} Licensed under CC BY-NC 4.0. {around}"), (103, " ".join(NEGATIVES)), (104, f"{around} a copy of the software and its license {around}")]
    rows += [(None, f"{around} Released under the MIT License. {around}")]
    got = {r.doc_id: (r.families, r.n_license_lines) for r in scan_licenses(docs(spark, rows), model).collect()}
    families = [k for k, ts in TEMPLATES.items() for _ in ts]
    wrong = [(rows[i][1], got[i]) for i, k in enumerate(families) if got[i][0] != [k]]
    assert len(wrong) <= 2, wrong
    assert got[100] == (["MIT"], 1) and got[101] == (["Apache-2.0", "MIT"], 1) and got[102] == (["CC-BY-NC"], 1)
    assert got[103] == got[104] == ([], 0) and got[None] == (["MIT"], 1)


def test_rows_that_share_an_id_or_have_none(spark, model):
    mit, nc, sa = "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0."
    rows = [(1, mit), (1, mit), (2, mit), (2, nc), (2, None), (None, nc), (None, sa), (None, "no licence here"), (None, nc)]
    for limit in (100_000, 0):
        got = sorted(((r.doc_id, r.families, r.n_license_lines, [x.match for x in r.lines or ()]) for r in scan_licenses(docs(spark, rows), model, broadcast_rows=limit).collect()), key=repr)
        assert got == sorted([(1, ["MIT"], 1, [1.0])] * 2 + [(2, ["MIT"], 1, [1.0]), (2, ["CC-BY-NC"], 1, [1.0]), (2, [], 0, []), (None, ["CC-BY-NC"], 1, [1.0]), (None, ["CC-BY-NC"], 1, [1.0]), (None, ["CC-BY-SA"], 1, [1.0]), (None, [], 0, [])], key=repr)


def test_no_python_on_the_executors(spark, model, tmp_path):
    docs(spark, cases()).write.parquet(f"{tmp_path}/documents.parquet")
    plan = licensed_lines(spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id AS __row", "text"), model, "__row", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


#: Notices that aren't templates: other wordings, titles and shortened ones, by family; and lines of like words that name none.
HELD = {
    "Apache-2.0": ("This file is licensed to you under the Apache License, Version 2.0.", "Distributed under the terms of the Apache License 2.0", "Apache License, Version 2.0, January 2004", "You may not use this work except in compliance with the Apache License, Version 2.0"),
    "MIT": ("MIT License", "Licensed under the MIT license.", "The code is available under the MIT License, see LICENSE.", "the Software is furnished to any person to deal in the Software without restriction, free of charge"),
    "BSD": ("This software is released under the BSD License", "BSD 3-Clause License", "Redistribution and use in source and binary forms are permitted", "Neither the name of the author nor the names of contributors may be used to endorse products: BSD license"),
    "GPL": ("This program is licensed under the GNU General Public License version 2", "It is free software under the terms of the GNU General Public License, version 3", "Licensed under the GPL version 3.", "GNU General Public License v3.0 or later"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License", "Released under the LGPL version 2.1", "Licensed under the GNU Lesser General Public License, version 3."),
    "MPL": ("Licensed under the Mozilla Public License 2.0", "This file is subject to the terms of the Mozilla Public License", "Mozilla Public License, version 2.0"),
    "CC-BY-NC": ("This work is available under a Creative Commons Attribution-NonCommercial License", "Content licensed under CC BY-NC 4.0", "Creative Commons BY-NC 3.0"),
    "CC-BY": ("This article is licensed under a Creative Commons Attribution 4.0 License", "Content is licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"),
    "CC-BY-SA": ("Text is licensed under a Creative Commons Attribution-ShareAlike 4.0 License", "Content licensed under CC BY-SA 3.0", "Available under the Creative Commons Attribution-ShareAlike License"),
    "Unlicense": ("This software is released into the public domain", "Free and unencumbered software, for more information refer to unlicense.org"),
}
UNKNOWN = ("All rights reserved.", "You need a driver's license to rent a car in this state", "The fishing license may be obtained at the office", "Licensed under the European Union Public Licence, version 1.2", "The free software movement began in the eighties", "A copy of the report is available to any person on request", "Public transport in the region is free of charge for students", "The general public is invited to the opening", "Version 2.0 of the manual is out now", "Permission to enter is granted by the office", "The conditions are met when both sides agree to the terms", "Creative people share the commons of the old town", "Copyright 2020 Example Press", "The licence fee is paid by the household each year", "You should have received a letter along with this parcel")


def test_held_out_notices(spark, model):
    """Recall by family of notices that aren't templates, on lines of their own and within longer ones; nothing is found in other lines."""
    rows = [(i, t) for i, t in enumerate([t for ts in HELD.values() for t in ts] + list(UNKNOWN))]
    around = "the words of a page about thing 7 and the other of it"
    got = {r.doc_id: r.families for r in scan_licenses(docs(spark, rows + [(1000 + i, f"{around} {t} {around}") for i, t in rows]), model).collect()}
    families = [k for k, ts in HELD.items() for _ in ts]
    alone, within = ([got[base + i] == [k] for i, k in enumerate(families)] for base in (0, 1000))
    told = {k: (sum(a for a, f in zip(alone, families, strict=True) if f == k), sum(a for a, f in zip(within, families, strict=True) if f == k), len(ts)) for k, ts in HELD.items()}
    assert sum(alone) >= 28 and sum(within) >= 20, told
    assert not any(got[i] or got[1000 + i] for i in range(len(families), len(rows))), [t for i, t in rows[len(families) :] if got[i]]
