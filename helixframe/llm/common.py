"""Helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.checkpoints import cut

__all__ = ["cut", "n_partitions", "rows_of", "spread", "steady", "texts_of"]

#: Bytes of input to a partition of a shuffle at most; with what an operator adds, a task sorts a gigabyte or two.
PART_BYTES = 256 << 20


def n_partitions(docs: DataFrame | SparkSession) -> int:
    """spark.sql.shuffle.partitions, or more if the plan's estimate of docs' size asks for them."""
    spark = docs if isinstance(docs, SparkSession) else docs.sparkSession
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is spark:
        return least
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // PART_BYTES))  # a plan without statistics has a size beyond all bounds


def steady(docs: DataFrame) -> DataFrame:
    """docs with rows that come in the same order each time: what follows a shuffle is checkpointed."""
    return cut(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def spread(df: DataFrame, parts: int, bucket: str) -> DataFrame:
    """Send bucket number b to partition b modulo parts."""
    return df.repartitionById(parts, F.pmod(F.col(bucket), F.lit(parts)).cast("int"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
