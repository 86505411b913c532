"""Materialised stages that are found by what they were made from.

A stage is a name, input paths and parameters; a version of it is a fingerprint
of the input *files* (path, length, time of change) and of this library's code.
Changed input gives another version, so a stage never serves results of input
that is gone.
Versions are written aside and renamed when they are whole: a half-written one
is never found, and of two sessions that build one version the second keeps the
first one's.  When a new version is in place, versions before the last one are
removed (the last one stays for readers that have a plan over it).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langatlas.session import shared_dir
from langatlas.sinks.files import Files

KEPT_BEFORE = 1


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


@cache
def _code() -> str:
    """Fingerprint of this library's own files: changed code makes other stages."""
    home, read = Path(__file__).parent.parent, hashlib.sha256()
    for path in sorted(p for p in home.rglob("*.py") if "llm" not in p.parts):
        read.update(path.read_bytes())
    return read.hexdigest()


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Fingerprint of the files at ``paths``.  A single file is looked up on the
    spot; a folder's files are listed by Spark, and one row of sums comes back."""
    files, seen = Files(spark), []
    for path in sorted(paths):
        folder, length, changed = files.stat(path)
        if not folder:
            seen.append((path, length, changed))
            continue
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                  .select("path", "length", "modificationTime"))
        one = listed.agg(F.count(F.lit(1)), F.sum("length"),
                         F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
        seen.append((path, *one))
    return _digest(seen, _code())


class Catalogue:
    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        self.root = root or f"{shared_dir(spark)}/catalogue"

    def _folder(self, name: str, paths: list[str], params: dict) -> str:
        return f"{self.root}/{name}/{_digest(sorted(paths), params)}"

    def versions(self, name: str, paths: list[str], **params) -> list[str]:
        """Whole versions of a stage, oldest first."""
        folder = self._folder(name, paths, params)
        found = [v for v in self.files.names(folder) if not v.startswith("_")]
        return sorted(found, key=lambda v: self.files.stat(f"{folder}/{v}")[2])

    def folder(self, name: str, paths: list[str], build: Callable[[str], None],
               use_cached: bool = True, **params) -> str:
        """Folder of the version of today's input; ``build`` writes it to the folder
        that it is given, unless it is there (``use_cached=False``: always)."""
        home = self._folder(name, paths, params)
        version = fingerprint(self.spark, paths)
        place = f"{home}/{version}"
        if use_cached and self.files.exists(place):
            return place
        aside = f"{home}/_making-{uuid.uuid4().hex[:12]}"
        build(aside)
        if not use_cached:
            self.files.remove(place)
        if not self.files.rename(aside, place):
            self.files.remove(aside)          # another session was first
        before = [v for v in self.versions(name, paths, **params) if v != version]
        for old in before[:max(0, len(before) - KEPT_BEFORE)]:
            self.files.remove(f"{home}/{old}")
        return place

    def stage(self, name: str, paths: list[str], build: Callable[[], DataFrame],
              use_cached: bool = True, **params) -> DataFrame:
        """One table: its reader, written first if today's input has no version."""
        place = self.folder(name, paths, lambda to: build().write.parquet(to), use_cached,
                            **params)
        return self.spark.read.parquet(place)
