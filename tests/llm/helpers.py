"""Small inputs that the tests share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=()):
    """A documents table of (doc_id, text); extra columns are (name, value) pairs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], DOCS)
    for name, value in extra:
        df = df.withColumn(name, F.lit(value))
    return df


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
