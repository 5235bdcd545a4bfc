"""License scans: a trained paragraph classifier.

A paragraph is a line. Those words and pairs of neighbouring words that
some template has feed a sparse multinomial logistic regression over licence families and an unknown class,
fitted on the templates below, varied by dropped words, against a bounded sample
of corpus lines and of lines that mix template words. Its temperature is calibrated
on held-out lines, and a prediction is confirmed by comparison with the family's
templates: the share of the paragraph's n-grams that a template of it has.

A notice may share its line with other text. So each template is also laid on the
line at each of its cues; such a span of the template's length is a notice if it has
the same share of the template's n-grams and is predicted as the template's
family. Of spans that overlap, the one with the most n-grams found stays. A line can
name several families, once each; the whole line comes before its spans.

The scan is DataFrame expressions only. A line can be predicted as a family only
if its n-grams lift that family over the unknown class; of each n-gram that could,
the rarest word is a cue, and lines without a cue are left out before n-grams are
made (the result is the same).
Weights and templates are a small table of fixed size, and are broadcast.

Defined cases: null and empty texts have one empty line and no licence; a document
that repeats a line counts it each time; rows that share an identifier, or have none,
each have what their own text names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, literal_table, spread_join, table
from .linear import fit_multinomial, temperature

#: Phrases by which licences of each family are named or granted.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This software is distributed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.", "Released under the GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons BY-NC license.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons BY license.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose", "For more information, please refer to http://unlicense.org", "SPDX-License-Identifier: Unlicense",
    ),
}
SPLIT = r"[^\p{L}\p{N}]+"


def words_of(line: str) -> list[str]:
    return re.findall(r"[^\W_]+", line.lower())


def grams_of(words: list[str]) -> list[str]:
    """Distinct words and pairs, in the order of the DataFrame form."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in pairwise(words))]))


class LicenseModel:
    """Weights by n-gram and family, biases, temperature; the n-grams of the templates; the cues."""

    def __init__(self, negatives: list[str], seed: int = 7, variants: int = 12, templates: dict | None = None):
        rng = np.random.default_rng(seed)
        self.families = list(templates := templates or TEMPLATES)
        lines = [(words_of(t), k) for k, ts in enumerate(templates.values()) for t in ts]
        vocabulary = sorted({w for ws, _ in lines for w in ws})
        varied = [([w for w in ws if rng.random() > 0.1] or ws, k) for ws, k in lines for _ in range(variants)]
        unknown = len(self.families)
        mixed = [(list(rng.choice(vocabulary, rng.integers(3, 16))), unknown) for _ in range(40 * variants)]
        data = lines * 3 + varied + mixed + [(ws, unknown) for ws in map(words_of, negatives) if ws]
        own = {g: sorted({k for ws, k in lines if g in grams_of(ws)}) for g in dict.fromkeys(g for ws, _ in lines for g in grams_of(ws))}
        place = {g: i for i, g in enumerate(own)}
        rows, labels = [self._row(ws, place) for ws, _ in data], np.array([k for _, k in data])
        held = rng.random(len(data)) < 0.2
        weights, self.bias = fit_multinomial([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], len(own), unknown + 1, epochs=5, seed=seed, alpha=1.0, l1=0.5, l2=0.01)
        logits = np.array([r[1] @ weights[r[0]] + self.bias for r, h in zip(rows, held, strict=True) if h]).reshape(-1, unknown + 1)
        self.heat = temperature(logits, labels[held])
        #: (n-gram, weight of each class, families whose templates have it)
        self.table = [(g, weights[i].tolist(), own[g]) for g, i in place.items()]
        self.cues = self._cues(weights, list(own), negatives)
        cues = set(self.cues)
        #: (cue, its place in the template, template, family, length, distinct words, n-grams)
        self.seeds = [(w, i, t, k, len(ws), list(dict.fromkeys(ws)), grams_of(ws)) for t, (ws, k) in enumerate(lines) for i, w in enumerate(ws) if w in cues]

    def _cues(self, weights: np.ndarray, grams: list[str], negatives: list[str]) -> list[str]:
        """Words of which a line has one, or else the unknown class scores more than any family.

        The n-grams that need no cue are those most common in the corpus, as long as all
        of them together can't lift a family over the unknown class.
        """
        common = Counter(w for n in negatives for w in set(words_of(n)))
        word = {g: min(g.split(), key=lambda w: (common[w], -len(w), w)) for g in grams}
        lift = np.maximum(0, weights[:, :-1] - weights[:, -1:])
        room, used, cues = self.bias[-1] - self.bias[:-1], np.zeros(lift.shape[1]), set()
        for i in sorted(range(len(grams)), key=lambda i: -common[word[grams[i]]]):
            if np.all(used + lift[i] < room) and word[grams[i]] not in cues:
                used = used + lift[i]
            elif lift[i].any():
                cues.add(word[grams[i]])
        return sorted(cues)

    @staticmethod
    def _row(words: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a line that some template has."""
        ids = np.array([place[g] for g in grams_of(words) if g in place], np.int64)
        return ids, np.ones(len(ids))


def corpus_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> list[str]:
    """About ``sample`` lines of words that no template has, by a hash of the line: negatives for the fit."""
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).filter("length(line) > 0")
    share = F.pmod(F.xxhash64("line", F.lit(13)), F.lit(1 << 30))
    n = lines.count()
    named = r"(?i)licen[cs]e|copyright|creative commons|public domain|redistribut|spdx"
    return sorted(r[0] for r in lines.filter(share < int((1 << 30) * min(1.0, sample / max(n, 1)))).filter(~F.col("line").rlike(named)).select("line").collect())


def _grams(w: str) -> Column:
    """grams_of as an expression."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def _predicted(grams: DataFrame, model: LicenseModel, keys: list[str]) -> DataFrame:
    """The keys, and the best family's number i, its probability and, by family, the n-grams that its templates have; from keys and n-grams g."""
    k = len(model.families)
    rows = literal_table(grams.sparkSession, model.table, "gram string, weights array<double>, inside array<int>")
    # The outer form, as the planner would test g for emptiness first, and make it twice.
    met = grams.select(*keys, F.explode_outer("g").alias("gram")).join(F.broadcast(rows), "gram")
    sums = met.groupBy(*keys).agg(F.array(*(F.sum(F.col("weights")[i]) for i in range(k + 1))).alias("sums"), F.array(*(F.count_if(F.array_contains("inside", i)) for i in range(k))).alias("hits"))
    bias = F.array(*(F.lit(float(x)) for x in model.bias))
    logits = sums.select(*keys, "hits", F.zip_with("sums", bias, lambda x, c: (x + c) / model.heat).alias("z"))
    top = logits.select(*keys, "hits", "z", F.array_max("z").alias("top"), F.array_max(F.slice("z", 1, k)).alias("best"))
    return top.select(*keys, (F.array_position("z", F.col("best")) - 1).cast("int").alias("i"), "hits", (F.exp(F.col("best") - F.col("top")) / F.aggregate("z", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top")))).alias("probability"))


def _spans(cued: DataFrame, model: LicenseModel, confirm: float) -> DataFrame:
    """The distinct spans of lines that have the share of a template's n-grams, with their own n-grams g."""
    spark, keys = cued.sparkSession, ["uid", "__row", "__mark", "line_no"]
    # A row for each template: k its words, own its n-grams, least its words at least; n of a template's words have n - 1 of its pairs at most, but for repeated words.
    kinds = {t: (t, k, n, has, own, max(1, math.ceil((math.ceil(confirm * len(own) - 1e-9) + 1 - (n - len(has))) / 2))) for _, _, t, k, n, has, own in model.seeds}
    radius = max(x[2] for x in kinds.values())
    places = {}
    for w, i, t, *_ in model.seeds:
        places.setdefault(w, []).append({"at": i, "template": t})
    cues = literal_table(spark, list(places.items()), "cue string, places array<struct<at:int,template:int>>")
    templates = literal_table(spark, list(kinds.values()), "template int, i_own int, length int, has array<string>, own array<string>, least int")
    # The words around a cue are cut out before a row is made for each template, so that a long line isn't copied for each.
    near = cued.select(*keys, "w", F.posexplode_outer("w").alias("pos", "cue")).join(F.broadcast(cues), "cue")
    back = F.least(F.col("pos"), F.lit(radius))
    near = near.select(*keys, "pos", back.alias("back"), F.slice("w", F.col("pos") - back + 1, F.lit(2 * radius)).alias("v"), "places")
    laid = near.select(*keys, "pos", "back", "v", F.inline_outer("places")).join(F.broadcast(templates), "template")
    start, stop = F.greatest(F.col("back") - F.col("at"), F.lit(0)), F.least(F.col("back") - F.col("at") + F.col("length"), F.size("v"))
    first = F.col("pos") - F.col("back")
    laid = laid.select(*keys, "template", "i_own", "has", "own", "least", (first + start).alias("start"), (first + stop).alias("stop"), F.slice("v", start + 1, stop - start).alias("s"))
    laid = laid.filter(F.size(F.array_intersect("s", "has")) >= F.col("least"))
    laid = laid.select(*keys, "template", "i_own", "start", "stop", F.size("own").alias("whole"), F.array_intersect(_grams("s"), "own").alias("common"), _grams("s").alias("g"))
    laid = laid.withColumn("found", F.size("common")).filter(F.col("found") >= F.col("whole") * confirm - 1e-9)
    return laid.select(*keys, "template", "i_own", "start", "stop", "found", "whole", "g").distinct()


def licensed_lines(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """__row, __mark, line_no, family, probability, match: the families predicted and confirmed on each line, whole or in a span of it; rows of the same id and text are told once."""
    # Rows may share an id, so lines are told apart by their id and the hash of the row's text; a key of the row serves within one pass.
    lines = docs.select(F.monotonically_increasing_id().alias("uid"), "__row", F.xxhash64(text_col).alias("__mark"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))
    worded = lines.select("uid", "__row", "__mark", "line_no", F.array_remove(F.split(F.lower("line"), SPLIT), "").alias("w"))
    cued = worded.filter(F.arrays_overlap("w", F.lit(model.cues)))
    named = F.array(*map(F.lit, model.families))[F.col("i")].alias("family")
    grams = cued.select("uid", "__row", "__mark", "line_no", _grams("w").alias("g"))
    grams = grams.select("uid", "__row", "__mark", "line_no", "g", F.size("g").alias("n"))  # so that no row of the explosion carries the array
    whole = _predicted(grams, model, ["uid", "__row", "__mark", "line_no", "n"]).select("__row", "__mark", "line_no", named, "probability", (F.get("hits", F.col("i")) / F.col("n")).alias("match"))
    whole = whole.filter((F.col("probability") >= least) & (F.col("match") >= confirm))
    keys = ["uid", "__row", "__mark", "line_no", "template", "i_own", "start", "stop", "found", "whole", "g"]
    spans = _predicted(_spans(cued, model, confirm), model, keys).filter((F.col("i") == F.col("i_own")) & (F.col("probability") >= least))
    each = spans.select("uid", "__row", "__mark", "line_no", F.struct((-F.col("found")).alias("order"), (-F.col("found") / F.col("whole")).alias("second"), "start", "stop", named, "probability", (F.col("found") / F.col("whole")).alias("match")).alias("x"))
    each = each.groupBy("uid", "__row", "__mark", "line_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    kept = F.expr("aggregate(xs, slice(xs, 1, 0), (kept, x) -> IF(exists(kept, y -> y.start < x.stop AND x.start < y.stop), kept, array_append(kept, x)))")
    parts = each.select("__row", "__mark", "line_no", F.explode(kept).alias("x")).select("__row", "__mark", "line_no", "x.family", "x.probability", "x.match")
    both = whole.withColumn("rank", F.lit(0)).unionByName(parts.withColumn("rank", F.lit(1)))
    first = F.min(F.struct("rank", (-F.col("match")).alias("less"), (-F.col("probability")).alias("p"), "probability", "match")).alias("x")
    return both.groupBy("__row", "__mark", "line_no", "family").agg(first).select("__row", "__mark", "line_no", "family", "x.probability", "x.match")


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000, **options) -> DataFrame:
    """doc_id, n_lines, families (sorted, distinct), n_license_lines, lines (line_no, family, probability, match): a row for each row of docs."""
    model = model or LicenseModel(corpus_lines(docs, id_col, text_col))
    plain = docs.select(F.col(id_col).alias("__row"), F.col(text_col).alias("__text"))
    found = licensed_lines(plain, model, "__row", "__text", **options)
    each = found.groupBy(F.col("__row").alias("__hit"), F.col("__mark").alias("__of")).agg(F.array_sort(F.collect_set("family")).alias("families"), F.count_distinct("line_no").alias("n_license_lines"), F.array_sort(F.collect_list(F.struct("line_no", "family", "probability", "match"))).alias("lines"))
    base = plain.select(F.col("__row").alias("doc_id"), F.xxhash64("__text").alias("__mark"), F.size(F.split(F.coalesce("__text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    each = cut(each, "licences")
    out = spread_join(base, each, [F.col("doc_id").eqNullSafe(F.col("__hit")), F.col("__mark") == F.col("__of")], each.count(), broadcast_rows, "left")
    return out.select("doc_id", "n_lines", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), "lines")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence families that each document names, and on how many lines."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.concat_ws(",", "families").alias("families"), "n_license_lines")
