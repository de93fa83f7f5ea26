"""Hard negatives by exact scores from Kronecker-packed products.

Components of several candidates are biased to be no less than 0 and put in separated fields of one wide number:
``x1 + x2 * 2**w + ...``.  An anchor component times that number is its product with each of them at once, and the sum over
components stays apart in the fields as long as no sum reaches ``2**w``.  Unpacked and freed of the biases these
sums are the exact inner products.  The number is as wide as its kind is exact: 53 bits of a double, else 63 bits of a long, else an
integer of any length.

Two passes over blocks of candidates: the first scores each anchor with the candidates of its own label and keeps its
best, the positives; the second scores it with the rows of all other labels and keeps, for each positive, the best whose
score lies between ``low`` and ``high`` percent of the positive's.  Blocks hold a bounded number of rows, however many
have one label, and are dealt to the fields of a grid of a bounded number of tasks, which give their few best; so no group is ever in one task.

Rows with a null id, label or vector, or with null or non-finite components, take no part.  Rows with an anchor's own id are neither its
positives nor its negatives; other repeated rows count one by one, so do repeated anchors.  Vectors of different length have no
score, those of length 0 the score 0.  Components beyond the range of long count as its ends; scores are compared
exactly and set to the ends of long only in the result.  Ties go to the smaller id.  An anchor without positives, or without
rows in a window, gives none; an empty table gives none.  Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save
from .vectors import Best, blocks_of, fields, from_key, in_range, integer_vectors, met, order_key, pack_block

BLOCK, ANCHOR_BLOCK = 8192, 512
SLICE = 64  # anchors scored at once
WIDE = 8  # fields of a number of any length


def packed_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of each row of a with each row of x, whole numbers both."""
    m, n, d = len(a), len(x), a.shape[1]
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    low_a, low_x = int(a.min()), int(x.min())
    span_a, span_x = int(a.max()) - low_a, int(x.max()) - low_x
    width = max(1, (d * span_a * span_x).bit_length())
    reach = d * max(abs(low_a), abs(low_a + span_a)) * max(abs(low_x), abs(low_x + span_x))
    if 2 * width <= 53:
        kind, fields = np.float64, 53 // width
    elif 2 * width <= 63:
        kind, fields = np.int64, 63 // width
    else:
        kind, fields = object, WIDE
    whole = np.int64 if kind is not object and 4 * reach < 1 << 62 else object
    a1, x1 = (v.astype(object) - low if kind is object else v - low for v, low in ((a, low_a), (x, low_x)))
    rows = -(-n // fields)
    padded = np.concatenate([x1, np.zeros((rows * fields - n, d), x1.dtype)]).reshape(rows, fields, d)
    packed = sum(padded[:, f].astype(kind) * (1 << f * width) for f in range(fields))
    sums = np.dot(a1.astype(kind), packed.T)
    sums = sums.astype(np.int64) if kind is np.float64 else sums
    apart = np.stack([(sums >> f * width) & ((1 << width) - 1) for f in range(fields)], axis=2).reshape(m, rows * fields)[:, :n]
    return apart.astype(whole) + low_x * a1.sum(axis=1).astype(whole)[:, None] + low_a * x1.sum(axis=1).astype(whole)[None, :] + d * low_a * low_x


def first_rows(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores where ok, in order, ties to the smaller id."""
    if scores.dtype == object:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    if scores.shape[1] > k:
        held = np.where(ok, scores, np.iinfo(np.int64).min)
        ok = ok & (scores >= np.partition(held, -k, axis=1)[:, [-k]])
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _slices(queries: list[dict], row: dict) -> Iterator[tuple[dict, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some anchors of a block of queries, their scores with a block of candidates, which of these have another id, and their ids."""
    x_id = _longs(row["ids"])
    x = _longs(row["data"]).reshape(len(x_id), row["length"])
    for asked in queries:
        a_id = _longs(asked["a_ids"])
        a = _longs(asked["a_data"]).reshape(len(a_id), row["length"])
        for at in range(0, len(a), SLICE):
            part = slice(at, at + SLICE)
            yield asked, part, packed_products(a[part], x), a_id[part, None] != x_id[None, :], x_id


def _positives(k: int):
    """anchor (its row), id, key, score of the k best of each field of blocks of one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, blocks in fields(batches, ["label", "length"]):
            held = Best(k)
            for row in blocks:
                for asked, part, scores, other, x_id in _slices(queries, row):
                    r, c = first_rows(scores, other, x_id, k)
                    held.add(_longs(asked["a_rows"])[part][r], x_id[c], scores[r, c])
            anchor, ids, best = held.rows()
            columns = [pa.array(anchor), pa.array(ids), pa.array([order_key(s) for s in best], pa.binary()), pa.array([in_range(s) for s in best], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "key", "score"])

    return run


def _bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(k: int, low: int, high: int):
    """anchor, place (of the positive), id, key, score of the k best of each field of blocks in each positive's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, blocks in fields(batches, ["length"]):
            held: dict[int, Best] = {}
            for asked in queries:
                asked["windows"] = [[_bounds(from_key(key), low, high) for key in keys] for keys in asked.pop("positives")]
            for row in blocks:
                x_label = _longs(row["labels"])
                for asked, part, scores, other, x_id in _slices(queries, row):
                    other = other & (_longs(asked["a_labels"])[part, None] != x_label[None, :])
                    mine = asked["windows"][part]
                    for place in range(max(map(len, mine), default=0)):
                        there = np.array([place < len(w) for w in mine])
                        ends = [w[place] if place < len(w) else (1, 0) for w in mine]
                        if scores.dtype == object:
                            least, most = (np.array([e[side] for e in ends], object) for side in (0, 1))
                        else:
                            least, most = (np.array([in_range(e[side]) for e in ends], np.int64) for side in (0, 1))
                        ok = other & there[:, None] & (scores >= least[:, None]) & (scores <= most[:, None])
                        r, c = first_rows(scores, ok.astype(bool), x_id, k)
                        held.setdefault(place, Best(k)).add(_longs(asked["a_rows"])[part][r], x_id[c], scores[r, c])
            for place, best in held.items():
                anchor, ids, found = best.rows()
                columns = [pa.array(anchor), pa.array(np.full(len(anchor), place, np.int32)), pa.array(ids), pa.array([order_key(s) for s in found], pa.binary()), pa.array([in_range(s) for s in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "place", "id", "key", "score"])

    return run


def _pack_anchors(table: pa.Table) -> pa.Table:
    """pack_block with the keys of each anchor's positives."""
    packed = pack_block(("length", "a_block"), ("row", "label"))(table)
    return packed.append_column("positives", pa.array([table.column("positives").to_pylist()], pa.list_(pa.list_(pa.binary()))))


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose id is divisible by every."""
    given = (F.col(label) if isinstance(label, str) else label).cast("long").alias("label")
    whole = save(integer_vectors(vectors, scale, id_col, vec_col, given).filter("label IS NOT NULL"), "vectors")
    anchors = save(whole.filter(F.col("id") % every == 0).withColumn("row", F.monotonically_increasing_id()), "anchors")
    n, n_anchors = whole.count(), anchors.count()
    of = lambda count, size: F.greatest(F.lit(1), F.ceil(count / size))

    # Pass one: blocks of one label.
    one = ["label", "length"]
    count, asked = whole.groupBy(*one).agg(F.count(F.lit(1)).alias("n")), anchors.groupBy(*one).agg(F.count(F.lit(1)).alias("n_anchors"))
    sized = save(count.join(asked, one).withColumns({"of_blocks": of(F.col("n"), BLOCK), "of_asked": of(F.col("n_anchors"), ANCHOR_BLOCK)}), "labels")
    mine = whole.join(sized, one).withColumn("block", blocks_of(F.col("n"), BLOCK, "id", "values"))
    sizes = ["of_blocks", "of_asked"]
    mine = mine.groupBy(*one, *sizes, "block").applyInArrow(pack_block((*one, *sizes, "block")), "label long, length int, of_blocks long, of_asked long, block int, ids binary, data binary")
    asks = anchors.join(sized, one).withColumn("a_block", blocks_of(F.col("n_anchors"), ANCHOR_BLOCK, "row"))
    asks = asks.groupBy(*one, *sizes, "a_block").applyInArrow(pack_block((*one, *sizes, "a_block"), ("row",)), "label long, length int, of_blocks long, of_asked long, a_block int, ids binary, row binary, data binary")
    asks = asks.select(*one, *sizes, "a_block", F.col("ids").alias("a_ids"), F.col("row").alias("a_rows"), F.col("data").alias("a_data"))
    best = Window.partitionBy("anchor").orderBy(F.desc("key"), "id")
    found = met(mine, asks, one, F.col("of_blocks"), F.col("of_asked"), _positives(positives), "anchor long, id long, key binary, score long")
    found = save(found.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives), "positives")

    # Pass two: blocks of all labels; at most positives keys travel with an anchor.
    keys = found.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda p: p["key"]).alias("positives"))
    blocks = whole.withColumn("block", blocks_of(F.lit(n), BLOCK, "id", "values")).groupBy("length", "block")
    blocks = blocks.applyInArrow(pack_block(numbers=("label",)), "length int, block int, ids binary, label binary, data binary").withColumnRenamed("label", "labels")
    asks = anchors.join(keys, "row").withColumn("a_block", blocks_of(F.lit(n_anchors), ANCHOR_BLOCK, "row"))
    asks = asks.groupBy("length", "a_block").applyInArrow(_pack_anchors, "length int, a_block int, ids binary, row binary, label binary, data binary, positives array<array<binary>>")
    asks = asks.select("length", "a_block", F.col("ids").alias("a_ids"), F.col("row").alias("a_rows"), F.col("label").alias("a_labels"), F.col("data").alias("a_data"), "positives")
    near = met(blocks, asks, ["length"], of(F.lit(n), BLOCK), of(F.lit(n_anchors), ANCHOR_BLOCK), _negatives(negatives, low, high), "anchor long, place int, id long, key binary, score long")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("key"), "id")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(near, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
