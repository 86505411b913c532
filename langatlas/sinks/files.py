"""A few operations of the shared file system that Spark's writers do not offer."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file system of the session's paths (whatever their scheme)."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        found, fs = self._at(path)
        return fs.exists(found)

    def names(self, path: str) -> list[str]:
        """Names in a folder, hidden ones left out; none if it is not there."""
        found, fs = self._at(path)
        if not fs.exists(found):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(found))
                      if not n.startswith("."))

    def stat(self, path: str) -> tuple[bool, int, int]:
        """Whether it is a folder, its length, its time of change (ms)."""
        found, fs = self._at(path)
        status = fs.getFileStatus(found)
        return status.isDirectory(), status.getLen(), status.getModificationTime()

    def rename(self, source: str, target: str) -> bool:
        """Move to a name that is free; false if it is taken."""
        found, fs = self._at(target)
        if fs.exists(found):
            return False
        fs.mkdirs(found.getParent())
        return fs.rename(self._at(source)[0], found)

    def create(self, path: str, text: str) -> bool:
        """Write a small file; false if the name was taken before.  The check is the
        file system's own, so of two writers one has it."""
        found, fs = self._at(path)
        try:
            out = fs.create(found, False)
        except Exception as err:  # py4j wraps FileAlreadyExistsException
            if fs.exists(found):
                return False
            raise err
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def remove(self, path: str) -> None:
        found, fs = self._at(path)
        fs.delete(found, True)
