"""A training-data pipeline over the documents table: STAGES in order, each a function (spark, docs, sf_dir) to a DataFrame.

All stages but the last return the columns of documents. run() writes what a stage
returns as Parquet in the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molecast.llm.common import cut, spread_join, table
from molecast.llm.decontaminate import decontaminate
from molecast.llm.jaccard_join import near_copy_rows
from molecast.llm.mixing import TARGETS, quality_domains, resample
from molecast.llm.sharding import op3_sharding
from molecast.llm.toxicity import keep_civil, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labels of the documents it is given."""
    return keep_civil(docs, train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest identifier, null being the last."""
    found = cut(near_copy_rows(docs), "near_copies")
    # Rows with the same id and text: all are taken out, and one is put back.
    gone = found.filter("NOT stays OR copies > 1").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark"))
    again = found.filter("stays AND copies > 1").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark"))
    same = [docs["doc_id"].eqNullSafe(F.col("__gone")), F.xxhash64(docs["text"]) == F.col("__mark")]
    left = spread_join(docs, gone, same, gone.count(), 1_000_000, "left_anti")
    if not (many := again.count()):
        return left
    row = F.min(F.struct(*(docs[c] for c in docs.columns))).alias("row")
    one = spread_join(docs, again, same, many, 1_000_000, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(row)
    return left.unionByName(one.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rates say; the domains are those of the labels table."""
    return resample(docs, quality_domains(table(spark, sf_dir, "labels")), TARGETS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return op3_sharding(spark, sf_dir, docs)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("mixing sources to target weights", mixing), ("sharding", sharding)]

#: SQL can't express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage{i}")
    return docs
