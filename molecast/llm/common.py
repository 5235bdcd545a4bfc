"""Helpers that the training-data operators share."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut

__all__ = ["NULL_ID", "SPACE", "SPACE_CLASS", "cut", "literal_table", "runs", "small_side", "spread_join", "table"]

#: ASCII white space of the text contracts, as bytes and as a regular-expression class.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Stands for a null document id in numeric arrays; it is below every real id.
NULL_ID = -(1 << 63)


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark df for broadcast only if its counted rows are within the limit; beyond it the planner's shuffle join is used."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(left: DataFrame, right: DataFrame, on: list, rows: int, limit: int, how: str = "inner", salts: int = 8) -> DataFrame:
    """left joined with right, whose counted rows have few repeats of a key: by a broadcast within the limit, else by a shuffle in which each key of left is dealt over ``salts`` tasks, so that a hot one doesn't fill a task.

    The salt is of left's partitions, which a rerun of a lost task keeps.
    """
    if rows <= limit:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__deal", F.pmod(F.spark_partition_id(), F.lit(salts))).join(salted, [*on, F.col("__deal") == F.col("__salt")], how).drop("__deal", "__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table, from a literal: no task on the Python side makes it."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = ", ".join(x.replace(" ", ": ", 1) for x in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream of batches sorted by key into one table per run of equal keys. Only the current run is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = 0
        if held and len(keys) and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for stop in (keys[1:] != keys[:-1]).nonzero()[0] + 1:
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held)
            held, start = [], stop
        if len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
