"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from langatlas.session import scratch_path
from langatlas.sinks.files import Files

# Text that a Python task turns into Python objects at a time.
SLICE_BYTES = 2 << 20
# Spark removes a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and return a reader over it.

    Cuts the lineage: a lost executor costs the tasks it was running, never a
    replay of what was written, and both later reads see the same rows.  The
    shuffle files of the write go with its end, not when the driver's memory is
    next cleared up.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def drop_stages(*staged: DataFrame) -> None:
    """Remove what ``stage`` wrote, once everything read from it is staged itself."""
    for df in staged:
        Files(df.sparkSession).remove(df.stage_path)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def text_slices(batch: pa.RecordBatch, column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``
    (one row at least), whatever the batch size of the session is."""
    texts = batch.column(column)
    start = size = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        length = length or 0
        if i > start and size + length > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)
