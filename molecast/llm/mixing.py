"""Mixing sources to target weights by soft membership.

A classifier learned from a bounded sample of a labelled table gives each document's
posterior over domains, and nonnegative rates are fitted so that the expected tokens
of each domain, the sum of rate * tokens * posterior, match the targets. The fit of
the rates is made of distributed aggregations over all documents; the driver holds a
few numbers for each domain. Only DataFrame expressions run on rows.

The classifier is a sparse multinomial logistic regression, its temperature
calibrated on a fifth of the sample. Its features are lexical: a document's distinct
words and the first and last EDGE characters of each, hashed to BUCKETS, each
weighing one over the root of their number; and one for how many of its words are
distinct, by length, as repetition is. A text is scored within its row, by a fold of
the buckets over a table of weights of fixed size.

The rates start at 1 and minimise sum_k (expected_k - target_k)^2 over rates >= 0.
A projected-gradient step moves every rate by the same few numbers times its
posteriors, so that a document's rate is a fold over the steps so far, and no
iterate is ever stored: each step is one pass over the posteriors. A step that
doesn't lower the sum is taken back and halved. Where no rates can reach the targets
(a domain without tokens), the nearest totals are kept and the residual is told; a
fit that could still go on after its last step is an error.

Defined cases: a null or empty text has no tokens, and its rate is that of its
posterior; rows that repeat an identifier are rows of their own; labels that are
null or of unknown domains aren't learned from; without labels, or with one domain
only, posteriors are even, and rates are 1 if nothing can change them. An empty
table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, table
from .linear import fit_multinomial, temperature

#: Buckets of features; characters of a word's edges. Behind the buckets are SHAPES, by tenths of distinct words and powers of two of length.
BUCKETS, EDGE, SHAPES = 1 << 13, 3, 11 * 8
BLANKS = " \t\n\x0b\x0c\r"


def words(text: str) -> Column:
    """The words of a text column, lower-cased; null without any."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.when(bare != "", F.split(F.lower(bare), r"[\x20\x09-\x0D]+"))


def tokens() -> Column:
    return F.when(F.col("__words").isNull(), 0).otherwise(F.size("__words"))


def grams() -> Column:
    """The buckets of the distinct words of __words and of their edges; empty without any."""

    def bucket(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")

    each = F.transform(F.array_distinct("__words"), lambda w: F.array(bucket(w), bucket(F.concat(F.lit("^"), F.substring(w, 1, EDGE))), bucket(F.concat(F.substring(w, -EDGE, EDGE), F.lit("$")))))
    return F.coalesce(F.flatten(each), F.array().cast("array<int>"))


def shape() -> Column:
    """The place of a text's repetition and length, behind the buckets."""
    many = F.greatest(tokens(), F.lit(1))
    tenths = F.floor(F.coalesce(F.size(F.array_distinct("__words")), F.lit(0)) * 10 / many)
    return (F.lit(BUCKETS) + tenths * 8 + F.least(F.floor(F.log2(many.cast("double"))), F.lit(7))).cast("int")


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def fit_domains(rows: list[tuple[np.ndarray, int]], labels: np.ndarray, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS + SHAPES, domains) and biases, both divided by the temperature, from the buckets and shapes of a bounded sample."""
    if not len(rows) or len(set(labels.tolist())) < 2:
        return np.zeros((BUCKETS + SHAPES, count)), np.zeros(count)
    x = []
    for row, form in rows:
        ids, n = np.unique(row, return_counts=True)
        x.append((np.append(ids, form).astype(np.int32), np.append(n / np.sqrt(max(len(row), 1)), 1.0).astype(np.float32)))
    held = np.arange(len(x)) % 5 == 4
    weights, bias = fit_multinomial([r for r, h in zip(x, held, strict=True) if not h], labels[~held], BUCKETS + SHAPES, count, epochs=8, seed=seed, alpha=1.0, l1=0.1, l2=0.001)
    logits = np.array([v @ weights[ids] + bias for (ids, v), h in zip(x, held, strict=True) if h]).reshape(-1, count)
    heat = max(temperature(logits, labels[held]), 0.25)  # a separable sample would have none
    return weights / heat, bias / heat


class Domains:
    """A fitted classifier: the posteriors of any text column."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        # The first domain's score is 0, as only differences count.
        self.weights, self.bias = weights - weights[:, :1], bias - bias[0]

    def posteriors(self, docs: DataFrame, text_col: str) -> DataFrame:
        """docs with __tokens and __p0 .. beside its columns."""
        had = docs.columns
        wide = docs.withColumn("__words", words(text_col)).select(*had, tokens().cast("double").alias("__tokens"), grams().alias("__grams"), shape().alias("__shape"))
        root = F.sqrt(F.greatest(F.size("__grams"), F.lit(1)).cast("double"))
        scores = [F.lit(0.0)]
        for k in range(1, self.weights.shape[1]):
            held = F.split(F.lit(",".join(f"{v:.7g}" for v in self.weights[:, k])), ",").cast("array<double>")  # folded to one literal
            scores.append(F.aggregate("__grams", F.lit(0.0), lambda s, g: s + F.get(held, g)) / root + F.get(held, F.col("__shape")) + F.lit(float(self.bias[k])))  # noqa: B023
        scored = wide.select(*had, "__tokens", *(s.alias(f"__z{k}") for k, s in enumerate(scores)))
        found = _softmax([F.col(f"__z{k}") for k in range(len(scores))])
        return scored.select(*had, "__tokens", *(p.alias(f"__p{k}") for k, p in enumerate(found)))


def train_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", label: str = "domain", sample: int = 4000) -> Domains:
    """Fit on about ``sample`` labelled rows, chosen by a hash of the identifier, and never more than twice as many."""
    known = labelled.select(F.col(id_col).alias("__key"), F.col(label).alias("__label")).filter(F.col("__label").isin(domains) & F.col("__key").isNotNull())
    share = F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(share < min(1.0, sample / max(known.count(), 1)))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(small_side(picked, picked.count(), 4 * sample), F.col("__doc") == F.col("__key"))
    # What comes to the driver is bounded in rows, and in buckets of a row; one order, so that the fit doesn't depend on the partitions. Rows come one by one, as lists of numbers are large.
    told = rows.select("__label", F.xxhash64("__text").alias("__mark"), words("__text").alias("__words")).select("__label", "__mark", F.slice(grams(), 1, 4 * BUCKETS).alias("g"), shape().alias("s")).orderBy("__mark", "__label").limit(2 * sample)
    got = [(r["__label"], np.array(r["g"], np.int16), r["s"]) for r in told.toLocalIterator()]
    return Domains(*fit_domains([x[1:] for x in got], np.array([domains.index(x[0]) for x in got], int), len(domains)))


def _rate(history: list[list[float]], count: int) -> Column:
    """The rate after the steps so far: each moves it by the step's numbers times the posteriors, and is cut off at 0."""
    if not history:
        return F.lit(1.0)
    past = F.array(*(F.array(*map(F.lit, g)) for g in history))
    return F.aggregate(past, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum((F.col(f"__p{k}") * g[k] for k in range(1, count)), F.col("__p0") * g[0])))


@dataclass
class Rates:
    """The steps that give each text its rate, and what remains between the shares they reach and the targets."""

    steps: list[list[float]] = field(default_factory=list)
    residual: list[float] = field(default_factory=list)


def fit_rates(rows: DataFrame, targets: list[float], steps: int = 40, ridge: float = 1e-6, done: float = 1e-6) -> Rates:
    """The projected gradient over (__tokens, __p0 ..); targets are shares of the table's tokens.

    Each step is one aggregation: the residuals, and the curvature over the rates that
    are above 0, by whose inverse the gradient is scaled.
    """
    total, n = rows.agg(F.sum("__tokens")).first()[0] or 0.0, len(targets)
    if not total:
        return Rates()
    p, pairs = [F.col(f"__p{k}") for k in range(n)], [(i, j) for i in range(n) for j in range(i, n)]

    def look(history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = rows.withColumn("__r", _rate(history, n))
        free = F.when(F.col("__r") > 0, F.col("__tokens")).otherwise(0.0)
        got = rated.agg(*(F.sum(F.col("__r") * F.col("__tokens") * p[k]).alias(f"e{k}") for k in range(n)), *(F.sum(free * p[i] * p[j]).alias(f"h{i}_{j}") for i, j in pairs)).first()
        curve = np.zeros((n, n))
        for i, j in pairs:
            curve[i, j] = curve[j, i] = got[f"h{i}_{j}"] / total
        return np.array([got[f"e{k}"] / total - t for k, t in enumerate(targets)]), curve

    history: list[list[float]] = []
    residual, curve = look(history)
    length = 1.0
    for _ in range(steps):
        if np.abs(residual).max() < done:
            return Rates(history, residual.tolist())
        step = length * np.linalg.solve(curve + ridge * np.eye(n), residual)
        new, bent = look([*history, step.tolist()])
        gain = np.square(residual).sum() - np.square(new).sum()
        if gain > 0:
            history.append(step.tolist())
            small = gain < 1e-9 * np.square(residual).sum()
            residual, curve, length = new, bent, min(1.0, 2 * length)
        else:
            length /= 2
            small = length < 1e-6
        if small:  # nothing more to gain: these totals are the nearest
            warnings.warn(f"the targets can't be reached; the shares miss them by {residual.round(6).tolist()}", stacklevel=2)
            return Rates(history, residual.tolist())
    if np.abs(residual).max() < 1e-3:
        return Rates(history, residual.tolist())
    raise RuntimeError(f"rates didn't settle in {steps} steps; the shares miss the targets by {residual.tolist()}")


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", label: str = "domain") -> tuple[Domains, Rates, DataFrame]:
    """The classifier, the rates' fit, and (__id, __tokens, __p0 .., __rate) of each row. Domains are in the order of targets."""
    domains = train_domains(docs, labelled, list(targets), id_col, text_col, label)
    rows = cut(domains.posteriors(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body")), "__body").drop("__body"), "posteriors")
    rates = fit_rates(rows, list(targets.values()))
    return domains, rates, rows.withColumn("__rate", _rate(rates.steps, len(targets)))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", label: str = "domain") -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says. A row's rate is found from its own text once more, so that nothing is joined and no text is shuffled."""
    domains, rates, _ = fit_mixture(docs, labelled, targets, id_col, text_col, label)
    rated = domains.posteriors(docs, text_col).withColumn("__rate", _rate(rates.steps, len(targets)))
    return _repeated(rated, docs.columns, id_col)


def copies(rate: Column, ident: Column) -> Column:
    """A whole number whose mean is the rate: its floor, and one more for as large a share of the identifiers' hashes as the rest says."""
    return (F.floor(rate) + (F.pmod(F.xxhash64(ident.cast("string"), F.lit(21)), F.lit(1 << 30)) / float(1 << 30) < rate - F.floor(rate)).cast("int")).cast("int")


def _repeated(rated: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    # Outer, and filtered by what it makes: a filter on the count would be moved below, and find the features and the rate again for each use.
    counted = rated.select(*columns, copies(F.col("__rate"), F.col(id_col)).alias("__copies"))
    each = counted.select(*columns, F.explode_outer(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies")))).alias("__copy"))
    return each.filter("__copy IS NOT NULL").drop("__copy")


#: Domains of the labels table and their target shares of all tokens.
TARGETS = {"high": 0.95, "low": 0.05}


def quality_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The rate of every document, and the copies it stands for."""
    _, _, out = fit_mixture(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")), TARGETS)
    return out.select(F.col("__id").alias("doc_id"), F.col("__tokens").cast("long").alias("tokens"), *(F.col(f"__p{k}").alias(f"p_{d}") for k, d in enumerate(TARGETS)), F.col("__rate").alias("rate"), copies(F.col("__rate"), F.col("__id")).alias("copies"))
