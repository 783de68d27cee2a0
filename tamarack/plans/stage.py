"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset, as in local tests, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tamarack-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as files, so that a lost executor loses nothing."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: columns and row groups can be skipped later."""
    path = fresh_path(df.sparkSession, name)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Manifest:
    """Which parts of a folder count: a small file of JSON for every version, of which the latest holds.

    A version is written beside its place and then renamed to it, so that readers see the old state or the new one and never
    a mixture. A second writer that starts from the same version fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = self._path(f"{folder.rstrip('/')}/_manifest")
        self.fs = self.folder.getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def read(self) -> tuple[int, dict]:
        """Version and state; (0, {}) where nothing was committed yet."""
        if not self.fs.exists(self.folder):
            return 0, {}
        known = [int(n) for n in (s.getPath().getName() for s in self.fs.listStatus(self.folder)) if n.isdecimal()]
        if not known:
            return 0, {}
        stream = self.fs.open(self._path(f"{self.folder}/{max(known):012d}"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return max(known), json.loads(raw)

    def commit(self, version: int, state: dict) -> int:
        """Writes the state that follows ``version``; FileExistsError if another writer was first."""
        self.fs.mkdirs(self.folder)
        made, place = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{version + 1:012d}")
        out = self.fs.create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(made, place):
            self.fs.delete(made, False)
            raise FileExistsError(f"another writer made version {version + 1} of {self.folder}")
        for old in range(max(1, version - 8), version - 4):
            self.fs.delete(self._path(f"{self.folder}/{old:012d}"), False)
        return version + 1


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
