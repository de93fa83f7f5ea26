"""Stores that grow by batches: parsed files, an index of chunks, drawing entities.

What a store holds is said by its commits, small files that come under their names in one step.  Data of a batch is written
before its commit, in folders of its own, so a batch that was killed leaves nothing that a reader sees, and
one that runs again after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Folder

BUCKETS = 64


class ParsedFiles:
    """The result sets of files that were parsed, each row with the identity of its file."""

    def __init__(self, spark: SparkSession, folder: str, sets: dict[str, str]):
        """sets: the name and the schema of each result set, without the identity."""
        self.spark, self.folder, self.sets = spark, folder.rstrip("/"), sets
        self.commits = Folder(spark, f"{self.folder}/commits")

    def _batches(self) -> list[dict]:
        return [json.loads(self.commits.text(n)) for n in self.commits.names() if not n.startswith(".")]

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{b['at']}/{name}" for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def load(self, name: str, files: DataFrame) -> DataFrame:
        """The rows of a result set that belong to files (identity); those of earlier versions of a file stay out."""
        return self._read(name, f"identity string, {self.sets[name]}").join(files.select("identity").distinct(), "identity", "left_semi")

    def pending(self, files: DataFrame) -> DataFrame:
        """The files whose identity no committed batch has."""
        return files.join(self._read("files", "identity string").distinct(), "identity", "left_anti")

    def add(self, batch: str, files: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]]) -> bool:
        """Parse the pending ones of files and commit what parse makes of them under the batch's name; False if that was committed before."""
        if batch in self.commits.names():
            return False
        at = f"batch-{uuid.uuid4().hex}"
        self.pending(files).write.parquet(f"{self.folder}/{at}/pending")
        todo = self.spark.read.schema(files.schema).parquet(f"{self.folder}/{at}/pending")
        made = parse(todo)
        for name, schema in self.sets.items():
            columns = [c.split()[0] for c in ("identity string, " + schema).split(", ")]
            made[name].select(*columns).write.parquet(f"{self.folder}/{at}/{name}")
        todo.select("identity").distinct().write.parquet(f"{self.folder}/{at}/files")
        return self.commits.put(batch, json.dumps({"at": at}))


class ChunkIndex:
    """Chunks by source, in buckets of sources; a batch replaces the chunks of the sources that it brings and leaves other buckets' files alone."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, source: str = "source", buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.source, self.buckets = spark, folder.rstrip("/"), schema, source, buckets
        self.commits = Folder(spark, f"{self.folder}/commits")

    def _state(self) -> dict:
        """The last commit: its batch and where the chunks of each bucket are."""
        done = [n for n in self.commits.names() if not n.startswith(".")]
        return json.loads(self.commits.text(max(done))) if done else {"batch": -1, "at": {}}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in sorted(paths))) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(list(self._state()["at"].values()))

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.source)), F.lit(self.buckets)).cast("int")

    def replace(self, batch: int, fresh: DataFrame) -> bool:
        """Put the chunks of batch number batch in place of their sources' old ones; False if it, or a later one, was committed before."""
        from ..operators.documents import replace_by_source

        state = self._state()
        if batch <= state["batch"]:
            return False
        columns = [c.split()[0] for c in self.schema.split(", ")]
        fresh = fresh.select(*columns).withColumn("_bucket", self._bucket())
        at = f"batch-{batch:012d}-{uuid.uuid4().hex}"
        fresh.write.partitionBy("_bucket").parquet(f"{self.folder}/{at}/fresh")
        fresh = self.spark.read.schema(f"{self.schema}, _bucket int").option("basePath", f"{self.folder}/{at}/fresh").parquet(f"{self.folder}/{at}/fresh")
        touched = [str(r[0]) for r in fresh.select("_bucket").distinct().collect()]  # at most buckets
        old = self._read([state["at"][b] for b in touched if b in state["at"]]).withColumn("_bucket", self._bucket())
        whole = replace_by_source(old, fresh, self.source)
        whole.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.folder}/{at}/whole")
        placed = state["at"] | {b: f"{at}/whole/_bucket={b}" for b in touched}
        return self.commits.put(f"{batch:012d}", json.dumps({"batch": batch, "at": placed}))


def write_entities(entities: DataFrame, folder: str, groups: int = 16) -> None:
    """Entities (type_id, drawing_id, ...) in a folder for each type, sorted by drawing within files, so that scans read few types and row groups."""
    dealt = entities.repartition(F.col("type_id"), F.pmod(F.xxhash64("drawing_id"), F.lit(groups)))
    dealt.sortWithinPartitions("type_id", "drawing_id").write.partitionBy("type_id").parquet(folder)


def scan_entities(spark: SparkSession, folder: str, types: DataFrame, names: list[str], columns: list[str], drawings: tuple[int, int] | None = None) -> DataFrame:
    """The named columns and type_name of the entities of given types (type_id, type_name), of drawings from the first to the last given.

    The dictionary of types is small; joined as a broadcast it prunes the folders that are listed, and the bounds of drawings reach the
    row groups.
    """
    wanted = F.broadcast(types.filter(F.col("type_name").isin(names)))
    rows = spark.read.parquet(folder)
    if drawings:
        rows = rows.filter(F.col("drawing_id").between(*drawings))
    return rows.join(wanted, "type_id").select("type_name", *columns)
