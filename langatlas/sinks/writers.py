"""Writers: stage overwrite, batch append, geo upsert, JSON export.

All paths are under the shared folder (``spark.checkpoint.dir``) or given by
the caller; nothing is written on a machine-local folder of a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from langatlas.schemas import DIST, GEO
from langatlas.sinks.files import Files
from langatlas.sinks.versions import VersionedTable


def overwrite_stage(df: DataFrame, path: str) -> DataFrame:
    """B1: replace the named result (Parquet) and return a reader over it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of ``path`` has it."""
    return Files(spark).exists(path)


def append_batch(df: DataFrame, path: str) -> None:
    """B2: append one batch."""
    df.write.mode("append").parquet(path)


def geo_table(spark: SparkSession, path: str) -> VersionedTable:
    """The location table (see ``sinks.versions``)."""
    return VersionedTable(spark, path, GEO, "location")


def write_dist_json(dist: DataFrame, path: str) -> None:
    """Density export as JSON lines (one document a line, with its part number if
    there is one)."""
    part = [c for c in ("part",) if c in dist.columns]
    dist.select(*DIST.fieldNames(), *part).write.mode("overwrite").json(path)
