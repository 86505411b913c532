"""A keyed table that can be read while it is replaced.

A table is folders of rows and numbered commit files.  Commit n names the
folders that make up version n, oldest first: of a key's rows the one in the
last folder counts, or, in a table of sums, they are added up.  A commit file is created only if its number is free -- the
file system decides -- so of two writers one has the version and the other
looks at the new version and tries again.  A writer that dies before its commit
leaves a folder that no version names.  Readers hold a version: its folders stay
until ``vacuum`` is told that nobody reads it.

Rows are stored by a hash bucket of their key, so an update reads the buckets
that its keys fall into, not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from langatlas.sinks.files import Files

BUCKET, FOLDER = "_bucket", "_folder"
BUCKETS = 16
#: Folders of a version beyond which a writer merges them.
MERGE_AT = 8
TRIES = 20


class VersionedTable:
    """``sums``: the columns that are added up (the others are the key); without
    them rows replace each other by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, *key: str,
                 buckets: int = BUCKETS, sums: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.sums = sums
        self.schema, self.files = schema, Files(spark)
        self.stored = StructType([*schema.fields, StructField(BUCKET, IntegerType())])

    # ---------------------------------------------------------------- versions
    def version(self) -> int:
        """The newest version; 0 is the empty table."""
        names = self.files.names(f"{self.path}/commits")
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def commit(self, version: int) -> dict:
        if version == 0:
            return {"folders": [], "writers": {}}
        (row,) = self.spark.read.text(f"{self.path}/commits/{version:010}.json").collect()
        return json.loads(row[0])

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows of a version (default: the newest): one a key, the last written.  With
        ``keys`` only the buckets that they fall into are read."""
        folders = self.commit(self.version() if version is None else version)["folders"]
        return self._rows(folders, keys).drop(BUCKET)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str], keys: DataFrame | None = None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        rows = None
        for number, folder in enumerate(folders):
            part = self.spark.read.schema(self.stored).parquet(f"{self.path}/rows/{folder}")
            part = part.withColumn(FOLDER, F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        if keys is not None:      # at most ``buckets`` numbers: partitions of the scan
            hit = keys.select(self._bucket().alias("b")).distinct().collect()
            rows = rows.where(F.col(BUCKET).isin([r["b"] for r in hit]))
        if len(folders) == 1:
            return rows.drop(FOLDER)
        if self.sums:
            return rows.groupBy(*self.key, BUCKET).agg(*(F.sum(c).alias(c) for c in self.sums)) \
                .select(*self.stored.fieldNames())
        fields = F.struct(*(c for c in self.stored.fieldNames()))
        return rows.groupBy(*self.key).agg(F.max_by(fields, F.col(FOLDER)).alias("r")).select("r.*")

    # ----------------------------------------------------------------- writing
    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        (rows.select(*self.schema.fieldNames(), self._bucket().alias(BUCKET))
         .repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/rows/{folder}"))
        return folder

    def update(self, build: Callable[[Callable[[DataFrame], DataFrame]], DataFrame],
               batch: tuple[str, int] | None = None) -> int:
        """Put the rows that ``build`` returns (one a key) into a new version.

        ``build`` gets a function that gives the present rows of the buckets of some
        keys, and is called again if another writer was first, so what it returns
        is right for the version that it is put on.  ``batch`` is the writer's name
        and a number that only grows: a number that a version has already is not
        put in again.  Returns the version that has the rows.
        """
        for _ in range(TRIES):
            before = self.version()
            state = self.commit(before)
            if batch is not None and batch[1] <= state["writers"].get(batch[0], -1):
                return before
            folders = state["folders"]
            new = build(lambda keys: self._rows(folders, keys).drop(BUCKET))
            folders = [*folders, self._write(new)]
            if len(folders) > MERGE_AT:
                folders = [self._write(self._rows(folders).drop(BUCKET))]
            writers = state["writers"] | (dict([batch]) if batch is not None else {})
            if self.files.create(f"{self.path}/commits/{before + 1:010}.json",
                                 json.dumps({"folders": folders, "writers": writers})):
                return before + 1
        raise RuntimeError(f"{TRIES} times another writer was first")

    def vacuum(self, oldest: int | None = None) -> int:
        """Remove the folders that no version from ``oldest`` (default: the newest) on
        names, those of dead writers included, and older commits.  Not while a
        writer is at work.  Returns how many folders went."""
        newest = self.version()
        oldest = newest if oldest is None else oldest
        named = {f for v in range(max(1, oldest), newest + 1) for f in self.commit(v)["folders"]}
        gone = [f for f in self.files.names(f"{self.path}/rows") if f not in named]
        for folder in gone:
            self.files.remove(f"{self.path}/rows/{folder}")
        for name in self.files.names(f"{self.path}/commits"):
            if int(name.removesuffix(".json")) < oldest:
                self.files.remove(f"{self.path}/commits/{name}")
        return len(gone)
