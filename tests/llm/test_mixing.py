import random

import pytest
from pyspark.sql import functions as F

from molecast.llm.mixing import BUCKETS, TARGETS, fit_domains, fit_mixture, fit_rates, quality_domains, resample, train_domains, words as words_of

from .helpers import docs, words


def rows(n=300):
    rng = random.Random(4)
    return [(i, " ".join(words(rng, 60)) if i % 4 else "JUNK% NAN% " * 30) for i in range(n)]


def labels(spark, data):
    return spark.createDataFrame([(i, "low" if "%" in (t or "") else "high") for i, t in data if i % 3 == 0] + [(7, None), (8, "other"), (None, "low")], "doc_id long, domain string")


def test_expected_totals_match_targets(spark):
    data = rows()
    for targets in ({"high": 0.9, "low": 0.1}, {"low": 0.5, "high": 0.5}, {"high": 1.3, "low": 0.0}):
        _, _, got = fit_mixture(docs(spark, data), labels(spark, data), targets)
        sums = got.agg(F.sum("__tokens"), *(F.sum(F.col("__rate") * F.col("__tokens") * F.col(f"__p{k}")) for k in range(2)), F.min("__rate")).first()
        assert all(abs(sums[k + 1] / sums[0] - t) < 2e-3 for k, t in enumerate(targets.values())) and sums[3] >= 0
        told = {r["__id"]: r["__p0"] for r in got.collect()}
        first = list(targets)[0]
        assert sum((told[i] > 0.5) == (("%" in t) == (first == "low")) for i, t in data) > 290


def test_rates_equal_a_plain_solver(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    p = rng.dirichlet((1, 1, 1), 200)
    w = rng.integers(1, 50, 200).astype(float)
    df = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(w, p, strict=True)], "__tokens double, __p0 double, __p1 double, __p2 double")
    target = [0.6, 0.3, 0.1]
    fit = fit_rates(df, target)
    r = np.ones(200)
    for g in fit.steps:
        r = np.maximum(0, r - p @ g)
    assert np.abs((r * w) @ p / w.sum() - target).max() < 1e-5 and np.abs(fit.residual).max() < 1e-5


def test_targets_out_of_reach_are_told(spark):
    df = spark.createDataFrame([(10.0, 0.5, 0.5), (20.0, 0.5, 0.5)], "__tokens double, __p0 double, __p1 double")
    with pytest.warns(UserWarning, match="miss"):
        fit = fit_rates(df, [0.9, 0.1])
    assert fit.residual == pytest.approx([-0.4, 0.4], abs=1e-4)


def test_posteriors_equal_brute_force(spark):
    """The expressions give what a plain loop over words and buckets gives."""
    data = [*rows(60), (500, None), (501, " \n"), (502, "Ünïcode ab a " * 500), (None, "w1 NAN%")]
    df = docs(spark, data, [("__p", 1)])
    model = train_domains(df, labels(spark, rows(60)), ["high", "low"])
    of = {r.w: r.b for r in df.select(F.explode(words_of("text")).alias("x")).distinct().select(F.explode(F.array("x", F.concat(F.lit("^"), F.substring("x", 1, 3)), F.concat(F.substring("x", -3, 3), F.lit("$")))).alias("w")).distinct().select("w", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).collect()}
    got = {(r.doc_id, r.text): (r["__p0"], r["__tokens"]) for r in model.posteriors(df, "text").collect()}
    for i, t in data:
        parts = (t or "").lower().split()
        grams = [of[g] for w in dict.fromkeys(parts) for g in (w, "^" + w[:3], w[-3:] + "$")]
        form = BUCKETS + len(set(parts)) * 10 // max(len(parts), 1) * 8 + min(max(len(parts), 1).bit_length() - 1, 7)
        z = model.weights[form, 1] + sum(model.weights[g, 1] for g in grams) / max(len(grams), 1) ** 0.5 + model.bias[1]
        assert got[i, t][0] == pytest.approx(1 / (1 + 2.718281828459045**z), abs=1e-6) and got[i, t][1] == len(parts)


def test_held_out_quality_of_the_tables(spark):
    """Labelled documents that the fit doesn't see are told apart by it."""
    sf = "/root/testdata/sf0.01"
    texts, known = spark.read.parquet(f"{sf}/documents.parquet"), quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    model = train_domains(texts, known.filter("doc_id % 4 <> 0"), list(TARGETS))
    test = model.posteriors(texts.join(known.filter("doc_id % 4 = 0"), "doc_id"), "text").select("domain", "__p0").collect()
    assert len(test) > 80 and sum((r["__p0"] > 0.5) == (r["domain"] == "high") for r in test) >= 0.97 * len(test)


def test_resampled_rows_keep_their_columns(spark):
    data = [*rows(120), (500, None), (501, ""), (502, "w1 w2 w3 " * 50), (503, "w2 w3"), (503, "w2 w3")]
    df = docs(spark, data, [("p0", 1), ("rate", 2.0), ("copies", 3)])
    got = resample(df, labels(spark, rows(120)), {"high": 0.9, "low": 0.1})
    assert got.schema == df.schema
    kept = [r.doc_id for r in got.collect()]
    good = {i for i, t in rows(120) if "%" not in t}
    assert good <= set(kept) and len(set(kept) - good) < 20


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    _, _, got = fit_mixture(docs(spark, rows(8)), none, {"high": 0.5, "low": 0.5})
    assert all(abs(r["__rate"] - 1) < 1e-6 and r["__p0"] == pytest.approx(0.5) for r in got.collect())
    assert fit_mixture(docs(spark, []), none, {"high": 0.5, "low": 0.5})[2].collect() == []
    assert len(fit_domains([], __import__("numpy").zeros(0, int), 2)[1]) == 2


def test_no_python_on_the_executors(spark, tmp_path):
    docs(spark, rows(20)).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = resample(df, spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "'low' AS domain"), {"low": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
