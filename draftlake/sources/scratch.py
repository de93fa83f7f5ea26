"""Tables and small files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the folder of spark.checkpoint.dir; a local folder is set only where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="draftlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is run inside go from the executors' disks as soon as it is done, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path and read again."""
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reaches, for the few small files that say what a store holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _child(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def names(self) -> list[str]:
        """The names in the folder; none if it is absent."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at)) if self._fs.exists(self._at) else []

    def text(self, name: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def put(self, name: str, text: str) -> bool:
        """Write a file under its name in one step; False, and nothing is changed, if the name is there already."""
        if self._fs.exists(self._child(name)):
            return False
        aside = self._child(f".{name}.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at)
        stream = self._fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.rename(aside, self._child(name)):
            return True
        self._fs.delete(aside, False)
        return False
