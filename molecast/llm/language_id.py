"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three letters of the lower-cased text, words padded by a blank,
are hashed to 2^BITS features. Document frequencies come from all documents that
may be learned from. Weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample: about ``sample`` rows of each language,
chosen by a hash of the identifier; a fifth of it calibrates the temperature. What
comes to the driver of a sampled text is its features, at most 2^BITS of them.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; where
no language can be learned, every text is; a null language isn't learned from, an
empty one is a language like others; more than ``most`` languages are an error;
repeated rows are predicted alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .linear import fit_multinomial, softmax, temperature

BITS, ORDERS = 15, 3
WIDTH = 1 << BITS


def grams(text: str) -> np.ndarray:
    """The hashed n-grams of a text, as they occur. Everything that isn't a letter counts as a blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    low = (code >= 97) & (code <= 122)
    other = np.flatnonzero(~low & (code > 127))
    letter = low
    if len(other):
        kinds, back = np.unique(code[other], return_inverse=True)
        letter[other] = np.array([chr(int(c)).isalpha() for c in kinds])[back]
    code[~letter] = 32
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    out, total = [], np.zeros(len(code), np.uint64)
    for n in range(1, ORDERS + 1):
        total = (total[: len(code) - n + 1] * np.uint64(0x100000001B3)) ^ code[n - 1 :] if len(code) >= n else np.empty(0, np.uint64)
        h = (total + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        keep = code[n - 1 :] != 32 if n == 1 else slice(None)
        out.append((h >> np.uint64(64 - BITS))[keep])
    return np.concatenate(out).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, mark = np.zeros(WIDTH, np.int64), 0, np.zeros(WIDTH, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            mark[:] = False
            mark[grams(text or "")] = True
            total += mark
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "counts"])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and documents with each feature. The executors add the parts up, two levels deep; the driver gets at most 64 arrays of 2^BITS."""
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies, "n long, counts binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(WIDTH, np.int64)
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "counts"])

    sums = parts.repartition(min(64, max(1, docs.sparkSession.sparkContext.defaultParallelism))).mapInArrow(add, "n long, counts binary").collect()
    return sum(r["n"] for r in sums), sum((np.frombuffer(r["counts"], np.int64) for r in sums), np.zeros(WIDTH, np.int64))


class Model:
    """Languages, inverse document frequencies, weights times these, biases, temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.langs, self.idf, self.bias, self.heat = langs, idf, bias, heat
        self.used = weights * idf[:, None]

    def scores(self, text: str) -> np.ndarray:
        """Logits; the features are term counts times idf, of unit length."""
        counts = np.bincount(grams(text), minlength=WIDTH).astype(np.float64)
        norm = np.sqrt(np.square(counts * self.idf).sum())
        return (counts @ self.used) / max(norm, 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.scores(text) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def tfidf(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values, of unit length."""
    values = counts * idf[ids]
    return ids, values / max(np.sqrt(np.square(values).sum()), 1e-12)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, at, ids, counts) of the sampled texts that have a letter."""
    for batch in batches:
        rows = []
        for lang, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if has_letter(text):
                ids, n = np.unique(grams(text), return_counts=True)
                rows.append((lang, at, ids.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "at", "ids", "counts"])


def labelled_sample(rows: DataFrame, label: str, by: Column, sample: int, most: int) -> DataFrame:
    """About ``sample`` rows of each label, by thresholds on a hash, and all of those with fewer. The thresholds are a small table, of at most ``most`` labels."""
    counts = rows.groupBy(F.col(label).alias("__of")).count()
    if len(counts.limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} values of {label}")
    share = F.pmod(F.xxhash64(by, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts), F.col(label) == F.col("__of")).filter(share < sample / F.col("count")).drop("__of", "count")


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = 800, most: int = 1000) -> Model:
    """Learn from all rows of docs that have a language: frequencies from every row, weights from about ``sample`` of each language and never more than twice as many in all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL")
    n, found = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + found)) + 1
    picked = labelled_sample(rows, "lang", F.col("doc_id").cast("string"), sample, most)
    kinds = max(1, rows.select("lang").distinct().count())
    # In the order of a hash and bounded, also where rows share an id.
    told = picked.select("lang", F.xxhash64("doc_id", "text").alias("at"), "text").mapInArrow(_counted, "lang string, at long, ids binary, counts binary").orderBy("at", "lang").limit(2 * sample * kinds)
    got = [(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in told.toLocalIterator()]
    langs = sorted({lang for lang, _, _ in got})
    if not langs:
        return Model([], idf, np.zeros((WIDTH, 0)), np.zeros(0), 1.0)
    x, y = [tfidf(ids, counts, idf) for _, ids, counts in got], np.array([langs.index(lang) for lang, _, _ in got])
    held = np.arange(len(x)) % 5 == 4
    weights, bias = fit_multinomial([r for r, h in zip(x, held, strict=True) if not h], y[~held], WIDTH, len(langs), l1=0.05, l2=0.05, alpha=1.0)
    logits = np.array([r[1] @ weights[r[0]] + bias for r, h in zip(x, held, strict=True) if h]).reshape(-1, len(langs))
    return Model(langs, idf, weights, bias, temperature(logits, y[held]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say: Callable = held.value.predict
        for batch in batches:
            langs, scores = zip(*map(say, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier's text, by this number of folds; a null identifier is in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those out of fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
