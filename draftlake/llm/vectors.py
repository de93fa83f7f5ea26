"""Vectors of whole numbers, dealt in blocks, and scores of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions

HELD = 64  # blocks of queries that a task holds at once
KEY_BYTES = 24  # of a score's key: room for every inner product of fewer than 2**60 longs


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """id, values (floor(scale * x), beyond the range of long its ends), length, and more columns of the rows that have an id
    and a vector without nulls and values that are not finite."""
    v = F.col("v")
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more).filter("id IS NOT NULL AND v IS NOT NULL")
    whole = whole.filter(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))))
    return whole.withColumn("values", F.transform(v, lambda e: F.floor(e * scale).cast("long"))).withColumn("length", F.size("v")).drop("v")


def blocks_of(n: Column, size: int, *by: str) -> Column:
    """One of as many blocks as n rows fill, by the hash of the columns by."""
    return F.pmod(F.xxhash64(*by), F.greatest(F.lit(1), F.ceil(n / size))).cast("int")


def pack_block(keys: tuple[str, ...] = ("length", "block"), numbers: tuple[str, ...] = ()):
    """One row of a block's keys, its ids, its vectors and further numbers, each as bytes of longs."""

    def run(table: pa.Table) -> pa.Table:
        packed = {k: table.column(k).slice(0, 1) for k in keys}
        for name, column in (("ids", "id"), *((c, c) for c in numbers)):
            packed[name] = pa.array([table.column(column).to_numpy().astype(np.int64).tobytes()])
        packed["data"] = pa.array([table.column("values").combine_chunks().flatten().to_numpy().astype(np.int64).tobytes()])
        return pa.table(packed)

    return run


def order_key(score: int) -> bytes:
    """Bytes in the order of scores."""
    return (int(score) + (1 << 8 * KEY_BYTES - 1)).to_bytes(KEY_BYTES, "big")


def from_key(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 8 * KEY_BYTES - 1)


def in_range(score: int) -> int:
    """The score, or the end of the range of long that it lies beyond."""
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def met(candidates: DataFrame, asked: DataFrame, keys: list[str], blocks: Column, asked_blocks: Column, run: Callable, schema: str) -> DataFrame:
    """What run gives of all blocks of candidates (keys, block, ...) with all blocks of queries (keys, a_block, ...) of equal keys.

    Both sides, which have keys in so many blocks and asked_blocks, are dealt to the rows and columns of a grid; a field of it is run by one task, the queries first.
    There are as many rows and columns as there are tasks, more columns only where a task would hold more than HELD blocks of queries:
    so the number of tasks is bounded, and no row of two blocks is ever made.
    """
    tasks = partitions(candidates.sparkSession)
    rows = F.least(blocks.cast("int"), F.lit(tasks))
    columns = F.least(asked_blocks.cast("int"), F.greatest(F.ceil(asked_blocks / HELD), F.ceil(F.lit(tasks) / rows)).cast("int"))
    left = candidates.withColumn("g", F.pmod("block", rows)).withColumn("h", F.explode(F.sequence(F.lit(0), columns - 1))).withColumn("asks", F.lit(False))
    right = asked.withColumn("h", F.pmod("a_block", columns)).withColumn("g", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("asks", F.lit(True))
    field = [*keys, "g", "h"]
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(2 * tasks, *field)
    return dealt.sortWithinPartitions(*field, F.desc("asks"), "block").mapInArrow(run, schema)


def fields(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[dict], Iterator[dict]]]:
    """For each field of the grid its blocks of queries and, one after the other, those of candidates."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).to_pylist()[0]

    for _, field in groupby(rows(), lambda row: tuple(row[c] for c in (*keys, "g", "h"))):
        queries, first = [], None
        for row in field:
            if not row["asks"]:
                first = row
                break
            queries.append(row)
        if queries and first is not None:
            yield queries, chain([first], field)


def first_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k highest scores, ties to the smaller id."""
    ranks = np.unique(scores, return_inverse=True)[1].reshape(len(scores))
    order = np.lexsort((ids, -ranks, groups))
    held = groups[order]
    return order[np.arange(len(held)) - np.searchsorted(held, held) < k]


class Best:
    """The k best of each group of what is added, of some blocks at a time."""

    def __init__(self, k: int, spare: int = 1 << 18):
        self.k, self.spare, self.parts, self.n = k, spare, [], 0

    def add(self, groups: np.ndarray, ids: np.ndarray, scores) -> None:
        scores = scores if isinstance(scores, np.ndarray) else np.array(scores, object)
        self.parts.append((groups, ids, scores))
        self.n += len(groups)
        if self.n > self.spare:
            self.parts = [self.rows()]
            self.n = len(self.parts[0][0])
            self.spare = max(self.spare, 2 * self.n)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups, ids and scores; the scores may be integers of any size."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups, ids, scores = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        kept = first_of(groups, scores, ids, self.k)
        return groups[kept], ids[kept], scores[kept]
