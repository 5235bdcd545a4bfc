"""Molecules as they arrive: the batch readers over file streams. Parsing keeps no state, so that a stream gives what a batch of the same files gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.molecules import format_column, read_molecules


def stream_molecules(spark: SparkSession, path: str, fmt: str, clean: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    return read_molecules(spark, path, fmt, clean, mode, stream=True)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str, column: str = "mol") -> StreamingQuery:
    """Text files of the molecules, exactly once by the sink's log; runs through what is there and stops."""
    text = format_column(df, fmt, column).select(F.rtrim(F.col("value"), F.lit("\n")).alias("value"))
    return text.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
