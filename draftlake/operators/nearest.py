"""Nearest vectors by cosine, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 8192, 1024
PAIRS = 8  # of blocks that one task meets
DIGITS = 9  # to which scores are rounded before they are put in order, so that equal vectors tie


def _unit_block(table: pa.Table) -> pa.Table:
    """One row of a block: its ids and its vectors, each of length 1."""
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    keys = {c: table.column(c).slice(0, 1) for c in ("dims", "block")}
    ids = table.column("id").combine_chunks()
    return pa.table(keys | {"ids": pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), ids), "data": pa.array([unit.tobytes()])})


def _scores(k: int, least: float | None):
    """The k best of each pair of blocks for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                q_ids, ids = batch.column("q_ids")[n].values, batch.column("ids")[n].values
                q, c = (np.frombuffer(batch.column(x)[n].as_py(), np.float64).reshape(m, -1) for x, m in (("q_data", len(q_ids)), ("data", len(ids))))
                score = np.round(q @ c.T, DIGITS)
                ok = score >= (-np.inf if least is None else least)
                if len(ids) > k:
                    ok &= score >= np.partition(score, -k, axis=1)[:, [-k]]  # with all that tie with the k-th
                r, col = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r)), ids.take(pa.array(col)), pa.array(score[r, col])], names=["query_id", "id", "score"])

    return run


def nearest(queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows of corpus (id, vector) with the greatest cosine, at least least, for each query (query_id, query_vector).

    Both sides are dealt in blocks of bounded size and each pair of blocks gives its best, so neither side is
    sent to all tasks.  Ties go to the smaller id.  Vectors that are null, of length 0, all 0, or hold nulls or values that are not finite have no score,
    as have vectors of different length.
    """

    def blocks(rows: DataFrame, name: str, vector: str, size: int) -> tuple[DataFrame, int]:
        rows = rows.select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
        n = max(1, -(-rows.count() // size))
        kind = rows.schema["id"].dataType.simpleString()
        dealt = rows.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
        return dealt.groupBy("dims", "block").applyInArrow(_unit_block, f"dims int, block int, ids array<{kind}>, data binary"), n

    (c, n), (q, m) = blocks(corpus, "id", "vector", BLOCK), blocks(queries, "query_id", "query_vector", QUERY_BLOCK)
    q = q.select("dims", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    kinds = [df.schema[x].dataType.simpleString() for df, x in ((queries, "query_id"), (corpus, "id"))]
    # Each task sends its state to the driver, so there are fewer tasks than pairs of blocks.
    pairs = c.join(q, ["dims", "block"]).repartition(max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * m // PAIRS)))
    found = pairs.mapInArrow(_scores(k, least), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
