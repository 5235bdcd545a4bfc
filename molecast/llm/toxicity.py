"""Toxicity: a counterfactual-regularised classifier.

Features are the presence of a document's words and of their beginnings of three to
six characters, hashed to 2^BITS. The logistic regression is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample. Of each
labelled text, sentences make counterfactual pairs: a sentence that mentions identity
terms is compared with itself after a swap of a term for each other one of its group
and after its removal; a text without a mention gets a neutral one in one sentence,
drawn by a seed, so that the penalty acts on every label. The squared change of the
sentence's logit within a pair is penalised, so that a mention alone doesn't tell.
Identity terms have no features of their beginnings, which other words could share.

Defined cases: a null or empty text has no features and gets the score of the bias;
without any label, or with one kind only, every score is 0; repeated rows score
alike, and labels that disagree count as they come. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, table
from .language_id import fold
from .linear import Ftrl

BITS = 18
WORD = re.compile(r"[^\W\d_]+")
#: Groups of identity terms; within a group one may stand for another.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("immigrants", "refugees", "citizens", "natives"), ("old", "young"), ("deaf", "blind", "disabled"),
)
GROUP = {term: group for group in IDENTITIES for term in group}
TERMS = tuple(GROUP)
SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    names = [word] + ([] if word in GROUP else [f"{word[:n]}*" for n in range(3, 7) if len(word) > n - 1])
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) >> (64 - BITS) for x in names]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), np.int32))


def sentences(text: str | None) -> list[set[str]]:
    """The words of each sentence that has any."""
    return [w for w in map(words_of, SENTENCE.split(text or "")) if w]


def counterfactuals(words: set[str]) -> list[set[str]]:
    """A sentence's words with each mentioned identity term swapped for each other one of its group, and without it."""
    out = []
    for term in sorted(words & GROUP.keys()):
        out += [words - {term} | {other} for other in GROUP[term] if other not in words]
        out.append(words - {term})
    return out


def pairs(text: str | None, rng: np.random.Generator) -> list[tuple[set[str], set[str]]]:
    """The counterfactual pairs of a text: of its sentences with mentions, or of one that is given a neutral mention."""
    own = sentences(text)
    told = [(s, c) for s in own for c in counterfactuals(s)]
    if told or not own:
        return told
    sentence = own[rng.integers(len(own))] | {TERMS[rng.integers(len(TERMS))]}
    return [(sentence, c) for c in counterfactuals(sentence)]


def fit(rows: Iterable[tuple[str | None, int]], epochs: int = 4, fairness: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias from (text, label) rows."""
    model, rng = Ftrl(1 << BITS, 1, alpha=0.5, l1=3.0, l2=0.1), np.random.default_rng(seed)
    data = []
    for text, y in rows:  # only the features are kept: texts and words of a sample would fill the driver
        changes = []
        for before, after in pairs(text, rng):
            a, b = features(before), features(after)
            gone, new = np.setdiff1d(a, b), np.setdiff1d(b, a)
            changes.append((np.concatenate([gone, new]), np.concatenate([np.ones(len(gone)), -np.ones(len(new))])))
        data.append((features(words_of(text)), float(y), changes))
    if len({y for _, y, _ in data}) < 2:
        return np.zeros(1 << BITS), -np.inf
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            ids, y, changes = data[i]
            row = ids, np.ones(len(ids))
            p = 1 / (1 + np.exp(-np.clip(model.score(row), -30, 30)))
            model.step(row, p - y)
            for change in changes:  # gradient of fairness / 2 * (logit - counterfactual logit)^2, shared by the pairs
                model.step(change, fairness / len(changes) * (change[1] @ model.weights(change[0])), bias=False)
    return model.weights()[:, 0], float(model.bias()[0])


class Scorer:
    """Scores texts; keeps the summed weight of each word's own features, as words recur."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.ids = np.flatnonzero(weights)
        self.values, self.bias = weights[self.ids], bias

    def start(self) -> None:
        self.weight, self.known = dict(zip(self.ids.tolist(), self.values.tolist(), strict=True)), {}

    def score(self, text: str | None) -> float:
        hit: set[int] = set()
        for word in words_of(text):
            if (got := self.known.get(word)) is None:
                if len(self.known) > 75_000:
                    self.known.clear()
                got = self.known[word] = tuple(f for f in word_features(word) if f in self.weight)
            if got:
                hit.update(got)
        if self.bias == -np.inf:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weight[f] for f in sorted(hit)), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000) -> Scorer:
    """Fit on the labelled documents: about ``sample`` of each label, chosen by a hash of the identifier."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__y IN (0, 1) AND __id IS NOT NULL")
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    share = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    bound = F.lit(False)
    for y, n in counts.items():
        bound = bound | ((F.col("__y") == y) & (share < min(1.0, sample / n)))
    picked = known.filter(bound)
    met = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(small_side(picked, picked.count(), 100_000), F.col("__doc") == F.col("__id"))
    # In the order of a hash, so that the fit doesn't depend on the partitions; never more than twice the sample, also where rows share an id. One partition of it is held at a time.
    rows = met.select("__text", "__y", F.xxhash64("__doc", "__text").alias("__at")).orderBy("__at", "__y").limit(4 * sample)
    return Scorer(*fit((r["__text"], r["__y"]) for r in rows.toLocalIterator()))


def score(self, text: str | None) -> float:
        hit: set[int] = set()
        for word in words_of(text):
            if (got := self.known.get(word)) is None:
                if len(self.known) > 75_000:
                    self.known.clear()
                got = self.known[word] = tuple(f for f in word_features(word) if f in self.weight)
            if got:
                hit.update(got)
        if self.bias == -np.inf:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weight[f] for f in sorted(hit)), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000) -> Scorer:
    """Fit on the labelled documents: about ``sample`` of each label, chosen by a hash of the identifier."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__y IN (0, 1) AND __id IS NOT NULL")
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    share = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    bound = F.lit(False)
    for y, n in counts.items():
        bound = bound | ((F.col("__y") == y) & (share < min(1.0, sample / n)))
    picked = known.filter(bound)
    met = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(small_side(picked, picked.count(), 100_000), F.col("__doc") == F.col("__id"))
    # In the order of a hash, so that the fit doesn't depend on the partitions; one partition of the bounded sample is held at a time.
    rows = met.select("__text", "__y").orderBy(F.xxhash64("__doc"), "__doc", F.xxhash64("__text"), "__y")
    return Scorer(*fit((r["__text"], r["__y"]) for r in rows.toLocalIterator()))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # at most 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        scorer.start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])
        scorer.start()  # the worker keeps the scorer for its next tasks, but not the words

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, scorer: Scorer, text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the cutoff."""
    held, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        scorer.start()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < cutoff for t in batch.column(at).to_pylist()], pa.bool_()))
        scorer.start()

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels out of fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = train(docs, labels.filter(fold("doc_id", 5) != 0))
    return score(docs, scorer).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
