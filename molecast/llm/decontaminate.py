"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask keeps some of the tokens in a window and ignores the others; the
hashes of the kept tokens at every position of the training texts are looked up
among those of the test items. Around each hit both token sequences are compared
on the hit's diagonal: the best segment there (a match counts 1, a substitution -2)
or the share of the whole item's tokens that match decides, so that substituted
tokens don't hide a copy.

Everything is DataFrame expressions in one stage over the texts: tokens are hashed
once, positions are generated and hashed in generated code, and the token array
is a reference until a hit survives the lookup; no text is shuffled. Of hits that
follow each other on a diagonal, the first is compared. The seeds are broadcast if
their counted rows are within a limit; otherwise positions are shuffled to the
seeds, and documents with hits are read a second time. Items with the same tokens
are looked up once.

Defined cases: a token is a run of letters and digits, lower-cased; null or empty
texts have none; items of fewer than SHORT tokens are found as exact copies of all
their tokens only, and of a single token only if it has ONE characters (a sentence of
a script without blanks is one token, and a short word isn't a test item); items of
fewer than MIDDLE tokens have additional, smaller masks; repeated items and documents
are reported under their identifiers once. Nothing to report gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, spread_join, table

#: The masks: positions kept in a window. They ignore every third token, the middle, or single tokens at uneven distances.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 6, 7), (0, 2, 3, 5, 8, 9))
#: Additional masks for items of fewer than MIDDLE tokens, most of whose windows hold a substitution.
SMALL = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 4, 5))
SHORT, MIDDLE, ONE = 8, 14, 12
#: Tokens to either side of a hit that are compared.
RADIUS = 64


def masks_for(lengths: set[int]) -> list[tuple[int, tuple[int, ...], int, int]]:
    """(number, positions, least and largest item length) of the masks that items of these lengths need."""
    exact = [(100 + n, tuple(range(n)), n, n) for n in sorted(lengths) if 0 < n < SHORT]
    small = [(10 + k, m, SHORT, MIDDLE - 1) for k, m in enumerate(SMALL)] if any(SHORT <= n < MIDDLE for n in lengths) else []
    plain = [(k, m, SHORT, 1 << 30) for k, m in enumerate(MASKS)] if any(n >= SHORT for n in lengths) or not exact else []
    return plain + small + exact


def tokens(text: str) -> Column:
    """Hashes of the tokens of a text."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keep: list[str], masks: list, by_length: bool = False) -> DataFrame:
    """A row for each position and mask of column t: at, the mask's place in the list, seed, and the columns to keep."""
    shortest = min(m[-1] for _, m, _, _ in masks)
    # The outer form, as the planner would make the tokens a second time to test for emptiness; null positions meet no seed.
    spots = df.select(*keep, "t", F.explode_outer(F.when(F.size("t") > shortest, F.sequence(F.lit(0), F.size("t") - F.lit(shortest + 1)))).alias("at"))
    each = []
    for number, m, low, high in masks:
        fits = F.col("at") + m[-1] < F.size("t")
        if by_length:
            fits = fits & F.size("t").between(low, high)
        # A mask that runs over the end hashes to null, and is dropped by the join.
        each.append(F.when(fits, F.xxhash64(F.lit(number), *(F.get("t", F.col("at") + p) for p in m))))
    return spots.select(*keep, "t", "at", F.posexplode(F.array(*each)).alias("k", "seed"))


#: Best segment, and tokens that match, on the diagonal of a hit. Column w has the document's tokens from at - RADIUS (or its start) on; token at is at place of the item.
SCORE = f"""
aggregate(
  zip_with(slice(w, least(at, {RADIUS}) - least(at, place, {RADIUS}) + 1, 2 * {RADIUS}), slice(item, place - least(at, place, {RADIUS}) + 1, 2 * {RADIUS}), (a, b) -> CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 1 ELSE -2 END),
  named_struct('now', 0, 'best', 0, 'same', 0),
  (s, x) -> IF(x IS NULL, s, named_struct('now', greatest(s.now + x, 0), 'best', greatest(s.best, s.now + x), 'same', s.same + IF(x = 1, 1, 0))),
  s -> named_struct('best', s.best, 'same', s.same))
"""


def _follows(masks: list) -> Column:
    """Whether the same mask hits one token earlier on the same diagonal; back is the hit's place in w."""
    out = F.lit(False)
    for k, (_, m, _, _) in enumerate(masks):
        same = F.lit(True)
        for p in m:
            same = same & F.coalesce(F.get("w", F.col("back") + (p - 1)) == F.get("item", F.col("place") + (p - 1)), F.lit(False))
        out = F.when(F.col("k") == k, same).otherwise(out)
    return (F.col("place") > 0) & (F.col("back") > 0) & out


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, least: int, share: float, whole: float, broadcast_rows: int) -> DataFrame:
    """doc_id, mark, item_id, first_token, score, matched: the copies. The mark is a hash of the text; with the id it names a row's text, also where ids are null or on several texts."""
    told = items.select(F.col(item_id).alias("item_id"), tokens(item_text).alias("t"), F.regexp_replace(F.coalesce(F.col(item_text), F.lit("")), r"[^\p{L}\p{N}]+", "").alias("__joined"))
    told = told.filter((F.size("t") > 1) | (F.length("__joined") >= ONE)).select("item_id", "t", F.xxhash64("t").alias("of_item"))
    told = cut(told, "items")
    tests = told.groupBy("of_item").agg(F.any_value("t").alias("t"))
    masks = masks_for({r[0] for r in tests.select(F.least(F.size("t"), F.lit(MIDDLE))).distinct().collect()})
    known = _seeds(tests, ["of_item"], masks, True).filter("seed IS NOT NULL").select("seed", "of_item", "k", F.col("at").alias("place"))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), tokens(text_col).alias("t"))
    window = F.slice("t", F.greatest(F.col("at") - RADIUS, F.lit(0)) + 1, F.lit(2 * RADIUS)).alias("w")
    rows = known.count()
    near = ["doc_id", "mark", "of_item", "k", "at", "place"]
    if rows <= broadcast_rows:
        # The window is cut in the stage that finds the hit, so that a long text isn't copied for each.
        hits = _seeds(plain, ["doc_id", "mark"], masks).drop("k").join(F.broadcast(known), "seed").select(*near, window)
    else:
        found = cut(_seeds(plain, ["doc_id", "mark"], masks).select("doc_id", "mark", "at", "seed").join(known, "seed").select(*near).distinct(), "hits")
        texts = docs.select(F.col(id_col).alias("of_id"), F.xxhash64(text_col).alias("of_mark"), F.col(text_col).alias("__text"))
        hit = found.select("doc_id", "mark").distinct()
        again = spread_join(texts, hit, [F.col("mark") == F.col("of_mark"), F.col("doc_id").eqNullSafe(F.col("of_id"))], hit.count(), broadcast_rows).select("of_id", "of_mark", tokens("__text").alias("t"))
        hits = found.join(again, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select(*near, window)
    named = tests.select(F.col("of_item").alias("of"), F.col("t").alias("item"))
    hits = hits.join(small_side(named, rows, broadcast_rows), F.col("of_item") == F.col("of")).withColumn("back", F.least(F.col("at"), F.lit(RADIUS)))
    size = F.size("item")
    scored = hits.filter(~_follows(masks)).select("doc_id", "mark", "of_item", (F.col("at") - F.least("at", "place")).alias("first_token"), F.least(F.lit(least), F.ceil(size * share)).alias("floor"), F.when(size < SHORT, size).otherwise(F.ceil(size * whole)).alias("most"), size.alias("size"), F.expr(SCORE).alias("s"))
    good = scored.filter(((F.col("size") >= SHORT) & (F.col("s.best") >= F.col("floor"))) | (F.col("s.same") >= F.col("most")))
    ids = told.select("item_id", F.col("of_item").alias("of_told"))
    met = good.join(small_side(ids, rows, broadcast_rows), F.col("of_item") == F.col("of_told"))
    return met.select("doc_id", "mark", "item_id", "first_token", F.col("s.best").alias("score"), F.col("s.same").alias("matched"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 12, share: float = 0.6, whole: float = 0.7, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, score, matched, first_token: the documents that hold a copy of an item.

    A copy is a segment that scores at least ``least``, or for short items ``share`` of
    their tokens; or the whole item with at least ``whole`` of its tokens unchanged.
    """
    found = _found(docs, items, id_col, text_col, item_id, item_text, least, share, whole, broadcast_rows)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("matched").alias("matched"), F.min("first_token").alias("first_token"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 12, share: float = 0.6, whole: float = 0.7, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text holds no copy of an item."""
    found = _found(docs, items, id_col, text_col, item_id, item_text, least, share, whole, broadcast_rows)
    bad = cut(found.select(F.col("doc_id").alias("__bad"), F.col("mark").alias("__mark")).distinct(), "contaminated")
    same = [docs[id_col].eqNullSafe(F.col("__bad")), F.xxhash64(docs[text_col]) == F.col("__mark")]
    return spread_join(docs, bad, same, bad.count(), broadcast_rows, "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold copies of benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
