import random

import numpy as np

from molecast.llm.toxicity import TERMS, Scorer, counterfactuals, features, fit, keep_civil, op10_toxicity, pairs, score, sentences, train, word_features, words_of

from .helpers import docs, words


def rows(n, seed, group=None):
    """Texts; toxic ones have a rude word. With a group, toxic ones mention it more often."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, toxic = words(rng, rng.randrange(3, 60), 300), i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(("grumble", "blasted", "snarkzu", "snarkab")))
        if group and rng.random() < (0.9 if toxic else 0.1):
            w.append(group)
        out.append((" ".join(w), int(toxic)))
    return out


def test_held_out_accuracy():
    s = Scorer(*fit(rows(600, 1)))
    s.start()
    test = rows(300, 2)
    assert sum((s.score(t) >= 0.5) == y for t, y in test) >= 295
    assert all(0 <= s.score(t) <= 1 for t, _ in test)


def test_swaps_lower_the_weight_of_mentions():
    data = rows(600, 1, "muslim")
    gap = {}
    for fairness in (0.0, 5.0):
        s = Scorer(*fit(data, fairness=fairness))
        s.start()
        logit = lambda t: np.log(s.score(t) / (1 - s.score(t)))  # noqa: B023, E731
        gap[fairness] = abs(logit("a muslim person") - logit("a christian person"))
    assert gap[0.0] > 0.5 and gap[5.0] < 0.6 * gap[0.0]
    assert counterfactuals({"a", "women"}) == [{"a", "men"}, {"a"}] and not counterfactuals({"a"})
    assert len(features(words_of("women"))) == 1


def mentioned(text, term):
    """The text with a neutral mention."""
    return f"{text} {term}"


def test_neutral_mentions_raise_fewer_false_alarms():
    """Where toxic texts mention groups more often, the penalty keeps neutral mentions from being flagged, and toxic texts are still found."""
    rng, told = random.Random(3), {}
    terms = ("muslims", "gay", "immigrants", "black")
    data = [(mentioned(t, rng.choice(terms)) if rng.random() < (0.9 if y else 0.02) else t, y) for t, y in rows(1500, 1)]
    data += [(mentioned(t, rng.choice(terms)), 1) for t, y in rows(300, 5) if not y]  # labelled toxic for a mention only
    test = rows(600, 2)
    for fairness in (0.0, 1.0, 5.0):
        s = Scorer(*fit(data, fairness=fairness))
        s.start()
        clean = [t for t, y in test if not y and s.score(t) < 0.5]
        false = sum(s.score(mentioned(t, rng.choice(terms))) >= 0.5 for t in clean) / len(clean)
        found = sum(s.score(t) >= 0.5 for t, y in test if y) / sum(y for _, y in test)
        told[fairness] = false, found
    assert told[0.0][0] > 0.2 and told[1.0][0] <= 0.3 * told[0.0][0], told
    assert told[5.0][0] <= told[1.0][0] + 0.01 and told[1.0][1] > 0.95, told
    print(told)


def test_sentences_without_mentions_get_neutral_ones():
    rng = np.random.default_rng(1)
    assert sentences("One two. three!\n\n4") == [{"one", "two"}, {"three"}]
    made = pairs("some words here. and there", rng)
    assert made and all(len(a - b) == 1 and (a - b) <= set(TERMS) for a, b in made)
    assert pairs(None, rng) == [] and pairs("12 !", rng) == []
    assert all(a == {"the", "women", "spoke"} for a, _ in pairs("the women spoke. others did", rng))


def test_scores_equal_brute_force(spark, tmp_path):
    """The query's scores are the logistic function of the summed weights of the distinct features; labels of the held-out fold aren't used."""
    import zlib

    data = rows(300, 4)
    base = [(i, t) for i, (t, _) in enumerate(data)] + [(900, None), (901, "blasted Women é"), (901, "blasted Women é")]
    docs(spark, base).write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    spark.createDataFrame([(i, 1, y if fold(i) else 1 - y) for i, (_, y) in enumerate(data)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op10_toxicity(spark, str(tmp_path)).collect()
    learn = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data) if fold(i)], "doc_id long, toxic int")
    s = train(docs(spark, base), learn)
    weight = dict(zip(s.ids.tolist(), s.values.tolist(), strict=True))
    text = dict(base)
    assert len(got) == len(base)
    for r in got:
        z = s.bias + sum(weight.get(f, 0.0) for f in {f for w in words_of(text[r.doc_id]) for f in word_features(w)})
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id) == 0)
    assert sum(r.predicted == data[r.doc_id][1] for r in got if r.doc_id < 300 and r.held_out) >= 0.95 * sum(r.doc_id < 300 and r.held_out for r in got)


def test_defined_cases(spark):
    data = rows(200, 1)
    base = [(i, t) for i, (t, _) in enumerate(data)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(3, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    scorer = train(docs(spark, base), labels)
    odd = [(1, None), (2, ""), (3, "blasted " * 20000), (4, "calm"), (4, "calm"), (None, "w1")]
    got = score(docs(spark, odd, [("score", 2.0), ("__y", 1)]), scorer).collect()
    told = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and told[1] == told[2] < 0.5 and told[3] >= 0.5 and told[4] < 0.5
    df = docs(spark, odd, [("score", 2.0)])
    stay = keep_civil(df, scorer)
    assert stay.schema == df.schema and sorted(str(r.doc_id) for r in stay.collect()) == ["1", "2", "4", "4", "None"]
    assert score(docs(spark, []), scorer).collect() == []
    blank = train(docs(spark, base), labels.filter("toxic = 7"))
    assert [r.score for r in score(docs(spark, [(1, "blasted")]), blank).collect()] == [0.0]
