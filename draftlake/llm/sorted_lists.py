"""Exact top k by inner product from sorted lists, without random access.

Each component of a block of vectors is a list sorted by value; a query reads every list from the
end that its own component favours, STEPS-th by STEPS-th part.  A vector's lower bound counts the list's worst
value for each component that was not read yet, the upper bound the frontier, the last value read.  Once at most
RESOLVED k vectors have an upper bound that reaches the k-th highest lower bound, no outsider can qualify: reading stops
and only these scores are resolved.

Queries and vectors are dealt in blocks, and these to the fields of a grid of a bounded number of tasks; each field gives its
k best, and the k best of those are the result.  Vectors that are null, or hold nulls or values that are not finite, take
no part; vectors of different length have no score, those of length 0 the score 0.  Components beyond the
range of long count as its ends; scores are exact integers of any size, put in order before those beyond the range of long are set to its ends.
Rows with a query's own id are not candidates for it; other repeated rows count one by one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import save
from .vectors import Best, blocks_of, fields, in_range, integer_vectors, met, order_key, pack_block

STEPS = 16  # parts in which a list is read
RESOLVED = 4  # times k vectors whose scores are resolved at the end
BLOCK, QUERY_BLOCK = 8192, 1024


def _open_rows(q: np.ndarray, order: np.ndarray, values: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The rows that may be among the k best for q, all but own, and how many entries of lists were read.

    Each row of order and values is one list, ascending: row numbers and their values.
    """
    d, n = order.shape
    ups, downs = np.flatnonzero(q >= 0), np.flatnonzero(q < 0)  # lists read from their upper and from their lower end
    exact = q.dtype == object
    worst = q * np.where(q >= 0, values[:, 0], values[:, -1])
    frontier, low = worst.copy(), np.full(n, worst.sum(), q.dtype if exact else np.float64)
    unseen, step = np.ones((d, n), q.dtype), -(-n // STEPS)
    for at in range(0, n, step):
        to = min(n, at + step)
        for sides, part, last in ((ups, slice(n - to, n - at), n - to), (downs, slice(at, to), to - 1)):
            if not len(sides):
                continue
            rows, base = order[sides, part], worst[sides, None]
            more = (q[sides, None] * values[sides, part] - base).ravel()
            if exact:
                np.add.at(low, rows.ravel(), more)
            else:
                low += np.bincount(rows.ravel(), more, n)
            unseen.ravel()[(rows + sides[:, None] * n).ravel()] = 0
            frontier[sides] = q[sides] * values[sides, last]
        high = low + (np.dot(frontier - worst, unseen) if exact else np.einsum("i,ij->j", frontier - worst, unseen))
        if n > k:
            bounds = np.where(own, low.min() - 1, low)
            least = np.partition(bounds, n - k)[n - k]
            open_ = np.flatnonzero((high >= least) & ~own)
        else:
            open_ = np.flatnonzero(~own)
        if len(open_) <= RESOLVED * k:
            break
    return open_, to * d


def best_of_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query index, candidate index, score) of each query's k best, ties to the smaller id; read gets the entries read for each query."""
    most = int(np.abs(q.astype(float)).max(initial=0)) * int(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most >= 1 << 61:
        q, x = q.astype(object), x.astype(object)
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else object  # bounds are whole numbers, exact in each
    order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
    values, sides = np.take_along_axis(x.T, order, axis=1).astype(kind), q.astype(kind)
    qi, xi, scores = [], [], []
    for r in range(len(q)):
        own = x_id == q_id[r]
        if q.shape[1]:
            open_, n = _open_rows(sides[r], order, values, own, k)
        else:
            open_, n = np.flatnonzero(~own), 0
        if read is not None:
            read.append(n)
        found = sorted((-int(s), int(i), int(o)) for s, i, o in zip((x[open_] * q[r]).sum(axis=1), x_id[open_], open_, strict=True))[:k]
        qi += [r] * len(found)
        xi += [o for _, _, o in found]
        scores += [-s for s, _, _ in found]
    return np.array(qi, np.int64), np.array(xi, np.int64), scores


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, blocks in fields(batches, ["length"]):
            asked = [(np.frombuffer(row["a_ids"], np.int64), row) for row in queries]
            q_id = np.concatenate([i for i, _ in asked])
            q_row = np.concatenate([(row["a_block"] << 40) + np.arange(len(i)) for i, row in asked])
            q = np.concatenate([np.frombuffer(row["a_data"], np.int64).reshape(len(i), row["length"]) for i, row in asked])
            best = Best(k)
            for row in blocks:
                x_id = np.frombuffer(row["ids"], np.int64)
                qi, xi, score = best_of_block(q, q_id, np.frombuffer(row["data"], np.int64).reshape(len(x_id), row["length"]), x_id, k)
                best.add(qi, x_id[xi], score)
            qi, ids, score = best.rows()
            keys, whole = pa.array([order_key(v) for v in score], pa.binary()), pa.array([in_range(v) for v in score], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q_id[qi]), pa.array(q_row[qi]), pa.array(ids), keys, whole], names=["query_id", "q_row", "vec_id", "key", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k best other rows."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, scale, id_col, vec_col)
    sizes = whole.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()

    def packed(rows: DataFrame, n: int, size: int) -> DataFrame:
        dealt = rows.withColumn("block", blocks_of(F.lit(n), size, "id", "values"))
        return save(dealt.groupBy("length", "block").applyInArrow(pack_block(), "length int, block int, ids binary, data binary"), "blocks")

    candidates = packed(whole, sizes["n"], BLOCK)
    asked = packed(whole.filter(F.col("id") % every == 0), sizes["q"], QUERY_BLOCK)
    asked = asked.select("length", F.col("block").alias("a_block"), F.col("ids").alias("a_ids"), F.col("data").alias("a_data"))
    blocks, asked_blocks = (F.lit(max(1, -(-size // most))) for size, most in ((sizes["n"], BLOCK), (sizes["q"], QUERY_BLOCK)))
    found = met(candidates, asked, ["length"], blocks, asked_blocks, _best(k), "query_id long, q_row long, vec_id long, key binary, score long")
    best = Window.partitionBy("query_id", "q_row").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
