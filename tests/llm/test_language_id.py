import random
import zlib

import numpy as np
import pytest

from molecast.llm.language_id import BITS, WIDTH, document_frequencies, grams, op2_language_id, predict, tfidf, train

from .helpers import docs

LANGS = {"aa": ["lam", "nor", "ope", "quo"], "bb": ["zhi", "xia", "que", "wen"], "cc": ["ñando", "çava", "ößter", "éta"]}


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        out.append((i, " ".join("".join(rng.choices(LANGS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang, "s", 1))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_scores(spark):
    model = train(frame(spark, rows(300, 1)), sample=80)
    test = rows(200, 2)
    got = {r.doc_id: r for r in predict(frame(spark, test), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in test) >= 196
    assert all(0 <= r.score <= 1 for r in got.values())


def test_defined_cases(spark):
    model = train(frame(spark, [*rows(120, 1), (500, None, "aa", "s", 0), (501, "lam", None, "s", 1), (502, "12", "", "s", 1)]), sample=50)
    assert model.langs == ["aa", "bb", "cc"]
    assert train(frame(spark, [*rows(60, 1), *((600 + i, "uvw uvw", "", "s", 1) for i in range(20))]), sample=50).langs == ["", "aa", "bb", "cc"]
    with pytest.raises(ValueError, match="more than 2"):
        train(frame(spark, rows(60, 1)), most=2)
    odd = [(1, None), (2, ""), (3, "12 !?"), (4, "lamnor " * 20000), (5, "lamnor"), (5, "lamnor"), (None, "zhixia wen")]
    got = sorted(((r.doc_id, r.lang_pred) for r in predict(docs(spark, odd, [("score", 3.0), ("lang_pred", "x")]), model).collect()), key=repr)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "aa"), (5, "aa"), (None, "bb")], key=repr)
    assert predict(docs(spark, []), model).collect() == []
    nothing = train(frame(spark, []))
    assert [tuple(r) for r in predict(docs(spark, [(1, "lam")]), nothing).collect()] == [(1, "und", 0.0)]


def test_frequencies_count_every_document(spark):
    data = [(i, t) for i, t, *_ in rows(50, 3)]
    n, found = document_frequencies(docs(spark, data))
    assert n == 50
    for g in set(grams("lam")):
        assert found[g] == sum(g in set(grams(t)) for _, t in data)
    ids, values = tfidf(*np.unique(grams("lam nor"), return_counts=True), np.ones(WIDTH))
    assert abs((values**2).sum() - 1) < 1e-9 and len(set(ids)) == len(ids)


def plain_grams(text):
    """N-grams of one to three letters, word by word: not the way of the library."""
    code = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in code:
        code = code.replace("  ", " ")
    out = []
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            if code[i : i + n] != " ":
                h = 0
                for c in code[i : i + n]:
                    h = (h * 0x100000001B3 & (1 << 64) - 1) ^ ord(c)
                out.append(((h + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - BITS))
    return out


def test_predictions_equal_brute_force(spark, tmp_path):
    """The query's predictions are those of a plain loop over n-grams with the model learned out of the held-out fold."""
    data = [*rows(150, 7), (900, "Lamnor, 12 ünd", None, "s", 1), (901, None, "aa", "s", 0), (902, "?!", "bb", "s", 0)]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    model = train(frame(spark, [r for r in data if fold(r[0]) != 1]))
    text, lang = {r[0]: r[1] for r in data}, {r[0]: r[2] for r in data}
    got = op2_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.held_out == (fold(r.doc_id) == 1)
        if not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = np.bincount(plain_grams(text[r.doc_id]), minlength=WIDTH) * model.idf
        z = (x / np.linalg.norm(x)) @ (model.used / model.idf[:, None]) + model.bias
        p = np.exp(z / model.heat - (z / model.heat).max())
        p /= p.sum()
        assert r.lang_pred == model.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-6
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_held_out_accuracy_on_the_tables(spark):
    got = op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
