"""Running per-molecule kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a kernel's output batch holds, and rows that are Python objects at once on its way in; molecules are small, their nested rows are not.
CHUNK, TAKE = 256, 64


def spread(df: DataFrame, bytes_each: int = 4 << 20) -> DataFrame:
    """Deal rows over tasks of about ``bytes_each`` of what the plan reads, and at least one to a core. Rows of costly kernels are small, so that the scan's splits would leave most cores idle; what is moved costs less than a kernel's step."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # a join's own estimate is the product of its sides
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(100_000, -(-size // bytes_each))))


def map_rows(df: DataFrame, kernel: Callable[[dict], Iterable[dict]], schema: str, reads: Sequence[str] = ()) -> DataFrame:
    """Apply a kernel from a row (a dict) to rows, batch by batch; nothing is shuffled and at most a chunk is held. ``reads`` names the columns that the kernel reads, all of them unless given.

    Where df comes straight from another kernel, both run in one Python worker, row by row, so that nested rows aren't handed to Spark and back.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    source, before = vars(df).get("_kernels") or (df.select(*dict.fromkeys(reads)) if reads else df, ())
    kernels = (*before, kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: Iterable[dict] = (row for batch in batches for at in range(0, batch.num_rows, TAKE) for row in batch.slice(at, TAKE).to_pylist())
        for step in kernels:
            rows = chain.from_iterable(map(step, rows))
        while held := list(islice(rows, CHUNK)):
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    out = source.mapInArrow(run, kind)
    out._kernels = source, kernels
    return out
