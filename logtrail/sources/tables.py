"""Tables that are replaced as a whole: each version is a folder, and a small file, put in place at the end, names it.

A write that fails leaves the version before; readers of a version that is replaced meanwhile keep reading it, until
`vacuum` removes it. Works on any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

VERSIONS = "_versions"


class Table:
    """A Parquet table at a path of its own, in versions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._new("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        folder = self._at(VERSIONS)
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit())

    def _folder(self, version: int) -> str:
        stream = self._files.open(self._at(VERSIONS, f"{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or an earlier one that is still there."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no version {version or ''} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{self._folder(version or known[-1])}")

    def replace(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """Writes df as the next version and, only when it is whole, makes it the latest. The number of rows, told by the write itself."""
        version, seen = (self.versions() or [0])[-1] + 1, Observation()
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        self._commit(version, folder)
        return seen.get["rows"]

    def _commit(self, version: int, folder: str) -> None:
        """A file of the version's number, by a rename; whoever comes second with a number fails, and its folder is never read."""
        self._files.mkdirs(self._at(VERSIONS))
        draft, final = self._at(VERSIONS, f".{uuid.uuid4().hex}"), self._at(VERSIONS, f"{version:012d}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(folder.encode()))
        stream.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last versions, and folders of writes that failed. Not while others write."""
        known = self.versions()
        kept = {self._folder(v) for v in known[-keep:]}
        for v in known[:-keep]:
            self._files.delete(self._at(VERSIONS, f"{v:012d}"), False)
        for f in self._files.listStatus(self._at()) if known else []:
            name = f.getPath().getName()
            if name.startswith("v") and name not in kept:
                self._files.delete(f.getPath(), True)
