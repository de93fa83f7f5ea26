"""Near-duplicate texts by bottom-k sketches of one hash function.

A text's set holds its distinct three-word shingles; two sets link when
``100 * intersection >= 85 * union``.  The steps:

1. One pass hashes each text's shingles and retains the K smallest values, its sketch.  Texts with one set are
   one *node*.  Nodes of whose sketch too few values lie in other sketches have no partner and leave.
2. Inverted lists of retained values generate overlaps.  Linked sketches share ``least_shared`` values, so they share one
   among the rarest of each; only those are listed.  Each node is first checked, a few times, against
   one node of another component, the one that most of its lists offer; only lists that then still hold several
   components are expanded: short ones to pairs, crowded ones by the elements in which their members differ from
   what most of them hold, so that no group makes all its pairs.
3. The bottom-k sketch of a pair's union is the K smallest values of both sketches.  How many of them both
   sketches hold estimates the similarity and filters pairs.
4. Exact Jaccard on the full sets verifies, and components follow from the links.

Sets of at most K shingles are their own sketches, so nothing is estimated there.  Beyond, a pair at the
threshold is lost by its sketches with a probability of at most LOSS, whatever the lengths.

Null and empty texts have size 0 and stand alone.  Repeated rows are kept, one result row each; rows
without id take part, and where a group has none, each of its rows is kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngram_join import FEW, SKETCH, TRIES, by_differences, components, grouped, screened_sets, verify, with_components
from .shared import save
from .sums import SUM_SCHEMA, sum_rows, summed

WIDTH, PERCENT = 3, 85
K = 128
LOSS = 1e-9
VALUE = np.dtype(np.uint64)


def surely_shared(k: int = K) -> int:
    """Values of k in the sketch of a union that both sets hold at the threshold, but for a chance of LOSS."""
    p, below = PERCENT / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > LOSS:
            return t
    return k


SURE = surely_shared()


def least_shared(size: int) -> int:
    """Retained values that a set of this size shares with any set it links with."""
    return min(-(-PERCENT * size // 100), SURE)


def least_shared_column(size: Column) -> Column:
    return F.least(F.ceil(PERCENT * size / 100), F.lit(SURE))


def _cells(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(SKETCH - 1)).astype(np.int64)


def _value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sketches hold a value of each cell."""
    count = np.zeros(SKETCH, np.int32)
    for batch in batches:
        for x in batch.column("sketch").to_pylist():
            np.add.at(count, _cells(np.frombuffer(x, VALUE)), 1)
    yield from sum_rows(count)


def _rarest(counts):
    """The lists that a node enters: the rarest of its values, as many as linked sketches must meet in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part, values = batch.slice(at, 4096), []
                for x, size in zip(part.column("sketch").to_pylist(), part.column("size").to_pylist(), strict=True):
                    v = np.frombuffer(x, VALUE)
                    order = np.lexsort((v, count[_cells(v)]))
                    values.append(v[order[: len(v) - least_shared(size) + 1]])
                n = [len(v) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(), n))], names=["value", "node"])

    return run


def union_estimate(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sketch of the union of two sets, of which these are the sketches, lets them link."""
    union, times = np.unique(np.concatenate([x, y]), return_counts=True)
    shared = int((times[:K] == 2).sum())
    return shared >= SURE if len(union) > K else 100 * shared >= PERCENT * len(union)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [union_estimate(np.frombuffer(x, VALUE), np.frombuffer(y, VALUE)) for x, y in zip(batch.column("left_sketch").to_pylist(), batch.column("right_sketch").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def near_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their union's sketch does not rule out; spares the join with whole sets."""
    for node, side in (("a", "left"), ("b", "right")):
        pairs = pairs.join(sets.select(F.col("node").alias(node), sketch(F.col("shingles")).alias(f"{side}_sketch")), node)
    return pairs.select("a", "b", "left_sketch", "right_sketch").mapInArrow(_estimated, "a long, b long")


def sketch(shingles: Column) -> Column:
    """The K smallest of a set's sorted hashes."""
    return F.substring(shingles, 1, K * VALUE.itemsize)


def offered_pairs(members: DataFrame, turn: int, tries: int) -> DataFrame:
    """For each node pairs (a, b) with the nodes of other components that most of its lists offer.

    A list of members (value, node, comp) offers one member of its least and one of its greatest component, the least node in
    turn 0 and any other in later ones.
    """
    at = F.struct("comp", (F.xxhash64("node", "value", F.lit(turn)) if turn else F.col("node")).alias("order"), "node")
    ends = members.groupBy("value").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low.comp < high.comp")
    other = F.when(F.col("low.comp") != F.col("comp"), F.col("low.node")).otherwise(F.col("high.node"))
    overlaps = members.join(ends, "value").groupBy("node", other.alias("other")).count()
    most = Window.partitionBy("node").orderBy(F.desc("count"), "other")
    best = overlaps.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= tries)
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def linked_nodes(sets: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of sets (node, size, shingles) that have a link."""
    spark = sets.sparkSession
    sketches = sets.select("node", "size", sketch(F.col("shingles")).alias("sketch"))
    count = summed(sketches.select("sketch").mapInArrow(_value_counts, SUM_SCHEMA), (SKETCH,), np.int32)
    lists = save(sketches.mapInArrow(_rarest(spark.sparkContext.broadcast(count)), "value long, node long"), "lists")
    tried = links = None
    comp = sets.select("node", F.col("node").alias("comp"))
    for turn, tries in enumerate(TRIES):
        pairs = offered_pairs(lists.join(comp, "node"), turn, tries)
        pairs = save(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs")
        found = save(verify(near_sketches(pairs, sets), sets, PERCENT), "links")
        tried, links = (tried.union(pairs), links.union(found)) if tried else (pairs, found)
        comp = sets.select("node").join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = lists.join(comp, "node")
    mixed = named.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    open_rows = save(named.join(mixed.select("value", (F.col("n") <= 2 * FEW + 1).alias("few")), "value"), "open")
    few = open_rows.filter("few")
    pairs = few.alias("x").join(few.alias("y"), "value").filter("x.comp <> y.comp AND x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = save(near_sketches(pairs.join(tried, ["a", "b"], "left_anti"), sets), "pairs")
    links = links.union(save(verify(pairs, sets, PERCENT), "links"))
    crowded = grouped(open_rows.filter("NOT few").withColumnRenamed("value", "sig"))
    return by_differences(crowded, sets, links, PERCENT, near_sketches)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reached by links, own included), kept (that is its own), n_copies (rows with the same set)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, nodes, sets = screened_sets(docs, WIDTH, lambda size: min(size, K), least_shared_column)
    found = with_components(rows, nodes, linked_nodes(sets))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_copies")
