import math
import random
import re

import pytest

from molecast.llm.decontaminate import MASKS, MIDDLE, ONE, SHORT, SMALL, contaminated, decontaminate

from .helpers import docs, words


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def copies(w, v, least=12, share=0.6, whole=0.7):
    """The scores on all diagonals on which the rule finds a copy: no masks."""
    out = []
    if len(v) < SHORT:
        return [(0, len(v))] if v and (len(v) > 1 or len(v[0]) >= ONE) and any(w[i : i + len(v)] == v for i in range(len(w) - len(v) + 1)) else []
    for d in range(1 - len(v), len(w)):
        pairs = [w[d + j] == v[j] for j in range(max(0, -d), min(len(v), len(w) - d))]
        now = best = 0
        for same in pairs:
            now = max(0, now + (1 if same else -2))
            best = max(best, now)
        if best >= min(least, math.ceil(len(v) * share)) or sum(pairs) >= math.ceil(len(v) * whole):
            out.append((best, sum(pairs)))
    return out


def brute(rows, items):
    """(doc, item) of all copies by the rule."""
    return sorted({(i, item) for i, t in rows for item, v in items if copies(toks(t), toks(v))}, key=repr)


def seeded(w, v):
    """Whether some mask hits a diagonal that the rule accepts."""
    if len(v) < SHORT:
        return True
    masks = [*MASKS, *(SMALL if len(v) < MIDDLE else ())]
    return any(all(w[i + p] == v[j + p] for p in m) for m in masks for i in range(len(w) - m[-1]) for j in range(len(v) - m[-1]))


def cases():
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate((9, 15, 30, 60, 200))] + [(10, "quite short it is"), (11, None), (12, ""), (13, "東京は日本の首都であり最大の都市"), (14, "word")]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120))
        if i % 3 == 0:
            v = toks(items[i // 3 % 5][1])
            for _ in range(len(v) // 12):
                v[rng.randrange(len(v))] = "changed"
            cut = v[: max(9, len(v) * (2 + i % 2) // 3)]
            w = w[:20] + [x.upper() + "," for x in cut] + w[20:]
        rows.append((i, " ".join(w)))
    return [*rows, (100, None), (101, ""), (102, "a b c word"), (105, "x quite SHORT, it is y"), (106, "quite short is it"), (107, "z。東京は日本の首都であり最大の都市。"), (103, items[2][1]), (103, items[2][1]), (104, "zz " * 20000 + items[3][1])], items


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_equals_brute_force(spark, limit):
    rows, items = cases()
    tests = spark.createDataFrame([*items, items[1]], "item_id long, text string")
    got = contaminated(docs(spark, rows, [("t", 1), ("at", 2), ("seed", 3), ("score", 4)]), tests, broadcast_rows=limit)
    text, item, want = dict(rows), dict(items), brute(rows, items)
    found = sorted(((r.doc_id, r.item_id) for r in got.collect()), key=repr)
    assert set(found) <= set(want) and len(found) == len(set(found))
    missed = set(want) - set(found)
    assert all(not seeded(toks(text[i]), toks(item[k])) for i, k in missed) and len(missed) <= 0.03 * len(want)
    assert {(105, 10), (107, 13), (103, 2)} <= set(found) and not {(102, 14), (106, 10)} & set(found)
    stay = decontaminate(docs(spark, rows), tests, broadcast_rows=limit)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, _ in rows if i not in {b[0] for b in found})


def test_recall_with_a_tenth_of_the_tokens_changed(spark):
    rng = random.Random(6)
    sizes = (8, 10, 12, 15, 20, 30, 64, 120)
    items = [(k, words(rng, n)) for k, n in enumerate(sizes * 25)]
    rows = []
    for k, v in items:
        w = [x if rng.random() > 0.1 else f"e{rng.randrange(10**6)}" for x in v]
        rows.append((k, " ".join(words(rng, rng.randrange(40)) + w + words(rng, rng.randrange(40)))))
    rows += [(1000 + i, " ".join(words(rng, 300))) for i in range(300)]
    tests = spark.createDataFrame([(k, " ".join(v)) for k, v in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, rows), tests).collect()}
    for n in sizes:
        of = [k for k, v in items if len(v) == n]
        assert sum((k, k) in got for k in of) >= 0.88 * len(of), n
    assert sum((k, k) in got for k, _ in items) >= 0.95 * len(items) and all(i == k for i, k in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs(spark, [(1, "a b c d e f g h i j")]), none).collect() == []
    assert contaminated(docs(spark, []), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")).collect() == []


def test_no_python_on_the_executors(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    plan = contaminated(docs(spark, [(1, "x")]).filter("doc_id > 0"), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_null_ids_and_ids_with_several_texts(spark, limit):
    rng = random.Random(4)
    item = words(rng, 30)
    bad = [" ".join(words(rng, 10) + item + words(rng, 10)) for _ in range(4)]
    clean = [" ".join(words(rng, 50)) for _ in range(4)]
    rows = [(None, bad[0]), (None, bad[1]), (None, clean[0]), (None, clean[1]), (None, None), (7, bad[2]), (7, clean[2]), (8, bad[3]), (9, clean[3])]
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = contaminated(docs(spark, rows), tests, broadcast_rows=limit).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.score, r.matched) for r in got) == [(0, 1, 30, 30), (7, 1, 30, 30), (8, 1, 30, 30)]
    stay = decontaminate(docs(spark, rows), tests, broadcast_rows=limit).collect()
    assert sorted(((r.doc_id, r.text) for r in stay), key=repr) == sorted([(None, clean[0]), (None, clean[1]), (None, None), (7, clean[2]), (9, clean[3])], key=repr)
