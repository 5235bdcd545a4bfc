import random
import re

import numpy as np
import pytest

import molecast.llm.jaccard_join as J
from molecast.llm.jaccard_join import CountTree, Words, jaccard_components, must_share, need, prefix, shingles

from .helpers import docs, words


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and label[i] != label[j]:
                label = [label[i] if x == label[j] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(((i, len(s), least.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=repr)


def cases(seed=5):
    rng = random.Random(seed)
    common = words(rng, 30)
    rows = []
    for _ in range(50):
        base = words(rng, rng.choice((3, 6, 12, 40, 150)), 400)
        for _ in range(rng.choice((1, 1, 2, 6))):
            w = base[:]
            for _ in range(int(len(w) * rng.choice((0, 0.02, 0.04, 0.1)))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = common + w
            rows.append((len(rows), rng.choice((" ", "\n", " \t")).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    chain = words(rng, 100)
    for k in range(12):  # neighbours link, ends don't
        rows.append((len(rows), " ".join(chain[: 100 - 3 * k] + [f"c{k}x{i}" for i in range(k)])))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (None, "one two"), (None, "lonely null id text here it is"), (905, "of of of " * 4000), (905, "of of of " * 4000), (906, "x\xa0y z")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # small tiles, and no broadcast
        monkeypatch.setattr(J, "TILE_SETS", 3)
        monkeypatch.setattr(J, "PAIR_SETS", 2)
        monkeypatch.setattr(J, "MANY", 4)
    rows = cases()
    got = jaccard_components(docs(spark, rows, [("key", 1), ("n", 2), ("component_id", 3)]), broadcast_rows=0 if small else 1_000_000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(docs(spark, [])).collect() == []
    assert sorted(tuple(r) for r in jaccard_components(docs(spark, [(1, None), (2, None)])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 3, 1 << J.SKETCH).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        keep = rng.random(len(a)) > 0.1
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**64, int(n * 0.1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            shared = len(np.intersect1d(prefix(a, classes, 80), prefix(b, classes, 80)))
            assert shared >= max(must_share(len(a), 80), must_share(len(b), 80))


def test_tree_finds_the_links_of_brute_force():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(6)]
    sets = sorted((np.unique(np.concatenate([b[rng.random(len(b)) > 0.08], rng.integers(0, 2**64, 3, dtype=np.uint64)])) for b in base for _ in range(9)), key=len)

    def parts(links):
        label = list(range(len(sets)))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return [label.index(x) for x in label]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= need(len(sets[i]) + len(sets[j]), 80)]
    assert parts(CountTree(sets).links(80)) == parts(every)


def test_repeated_words_have_distinct_shingles():
    text = " ".join(["a"] * 9 + ["b"] * 9 + ["a", "b"] * 9)
    w = text.split()
    assert len(shingles(text, Words())) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_null_ids_and_ids_with_several_texts(spark, limit):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = words(rng, 60)
        near = [*base[:-1], "end"]
        ids = [(None, None), (7, None), (None, 7), (7, 7), (7, 100 + k)][k % 5]
        rows += [(ids[0], " ".join(base)), (ids[1], " ".join(near)), (None, " ".join(words(rng, 60))), (7, " ".join(words(rng, 60)))]
    rows += [(None, " ".join(base))] * 5 + [(7, " ".join(near))] * 3
    got = jaccard_components(docs(spark, rows), broadcast_rows=limit).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_null_ids_alone_are_linked_by_their_own_texts(spark):
    rng = random.Random(9)
    rows = []
    for k in range(30):
        base = words(rng, 60)
        rows += [(k, " ".join(base[:-3] + [f"a{k}", f"b{k}", f"c{k}"])), (None, " ".join(base)), (None, " ".join(words(rng, 60)))]
    got = jaccard_components(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("pair_sets", [3, 512])
def test_large_parts_that_fall_apart(spark, monkeypatch, pair_sets):
    """One part of many components whose sizes and rare hashes are alike: what the first tiles miss is found by the pairs of blocks."""
    monkeypatch.setattr(J, "TILE_SETS", 4)
    monkeypatch.setattr(J, "PAIR_SETS", pair_sets)
    rng = random.Random(11)
    rows = []
    shared = words(rng, 70)
    for k in range(12):  # families share 70 of 100 words, members 97
        own = words(rng, 30, 5000)
        for m in range(5):
            w = shared + own
            w[75 + m] = f"m{k}x{m}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard_components(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert 2 < len({r.component_id for r in got}) < len(rows)


@pytest.mark.parametrize("pair_sets", [2, 3])
def test_links_that_only_one_pair_of_blocks_holds(spark, monkeypatch, pair_sets):
    """Families like stars: members link with their centre only, so that each link is a single pair, which may lie in any two blocks, or in one."""
    monkeypatch.setattr(J, "TILE_SETS", 2)
    monkeypatch.setattr(J, "PAIR_SETS", pair_sets)
    rng = random.Random(12)
    rows, shared = [], words(rng, 120)
    for k in range(12):
        own = words(rng, 80, 5000)
        base = shared + own
        rows.append((len(rows), " ".join(base)))
        for m in range(6):
            w = base[:]
            for j in range(4):  # each change breaks five of about 196 shingles
                w[125 + (12 * m + 19 * j) % 70] = f"m{k}x{m}x{j}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard_components(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert len({r.component_id for r in got}) > 1
