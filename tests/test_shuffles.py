"""Steps whose tasks must stay small: what one of them reads, holds or sends."""

import numpy as np
import pyarrow as pa
from draftlake.operators import chunks, nearest
from draftlake.operators import evidence as E
from draftlake.operators import layout as L
from draftlake.operators import rows as R
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_names_are_not_read_by_one_task(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"at {n} no. {k}") for k, n in enumerate(["PERU", "PER", "P", "none", ""] * 8)], "id int, address string").repartition(3)
    places = spark.createDataFrame([("PERU",), ("PER",), ("P",)], "place string")
    want = sorted((k, p, 3) for k, n in enumerate(["PERU", "PER", "P", "none", ""] * 8) for p in ("PERU", "PER", "P") if n.startswith(p))
    few = E.key_matches(texts, places, "address", "place")
    assert "SortMergeJoin" not in _plan(few) and "BroadcastHashJoin" in _plan(few)
    assert sorted((r.id, r.place, r.pos) for r in few.collect()) == want
    monkeypatch.setattr(E, "FEW_KEYS", 0)
    many = E.key_matches(texts, places, "address", "place")
    assert "_salt" in _plan(many)
    assert sorted((r.id, r.place, r.pos) for r in many.collect()) == want


def test_distinct_spans_stay_in_their_row(spark):
    kind = "doc_id long, spans array<struct<s: int, answers: string>>"
    docs = [(1, [(0, "b"), (6, "a"), (12, "b")]), (2, []), (3, None), (4, [(6, "x")])]
    once = R.joined_distinct(spark.createDataFrame(docs, kind), "doc_id", "spans", "|")
    assert "Exchange" not in _plan(once)
    assert sorted(map(tuple, once.collect())) == [(1, "b|a"), (4, "x")]
    twice = R.joined_distinct(spark.createDataFrame([*docs, (4, [(0, "y"), (18, "x")])], kind), "doc_id", "spans", "|")
    assert sorted(map(tuple, twice.collect())) == [(1, "b|a"), (4, "y|x")]


def test_chunks_are_held_for_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(chunks, "PART", 10)
    texts = pa.array(["aaaa", None, "bbbb", "cccc", "d" * 40, "e"])
    assert list(chunks.parts(texts)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(chunks.parts(texts.slice(2))) == [(0, 2), (2, 3), (3, 4)]
    rows = [(k, t) for k, t in enumerate(["one. two. three", None, "", "x" * 30, "a\nb"])]
    df = spark.createDataFrame(rows, "id int, text string").select("id", chunks.chunks(F.col("text"), 8, 2, chunks.PLAIN).alias("c"))
    marks = [chunks.re.compile(s) for s in chunks.PLAIN]
    assert {r.id: r.c for r in df.collect()} == {k: chunks.cut(t, 8, 2, marks) for k, t in rows}


def test_tasks_are_fewer_than_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 2)
    v = np.random.default_rng(1).normal(size=(60, 3))
    corpus = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id int, vector array<double>")
    found = nearest.nearest(corpus.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), corpus, 1)
    counts = [int(line.split("RoundRobinPartitioning(")[1].split(")")[0]) for line in _plan(found).splitlines() if "RoundRobinPartitioning(" in line]
    assert counts and max(counts) <= 15 * 30 // nearest.PAIRS + 1
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(k, k) for k in range(60)]


def test_rows_that_many_drawings_take_are_dealt(spark):
    drawings = spark.range(1, 41).select(F.col("id").alias("drawing_id"))
    layouts = drawings.select("drawing_id", F.lit(1).alias("layout"), F.lit(0).cast("long").alias("child_id"))
    rows = spark.range(400).select(F.lit(0).cast("long").alias("drawing_id"), F.col("id").alias("part"))
    found = L.with_layouts(drawings, layouts, rows)
    where = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in where) == 40 * 400 == found.distinct().count()
    assert len(where) > 1 and max(r["count"] for r in where) < 0.7 * 40 * 400


def test_takers_of_rows_are_not_sent_to_the_driver(spark, monkeypatch):
    """A taker is a row for each task, of which an estimate of its size knows nothing."""
    monkeypatch.setattr(L, "FEW_TAKERS", 10, raising=False)
    drawings = spark.createDataFrame([(i,) for i in range(50)], "drawing_id long")
    layouts = spark.createDataFrame([(i, 1, 100 + i % 2) for i in range(50)], "drawing_id long, layout int, child_id long")
    found = L.with_layouts(drawings, layouts, spark.createDataFrame([(100, 1), (100, 2), (101, 3), (7, 4)], "drawing_id long, value int"))
    assert sorted((r["drawing_id"], r["value"]) for r in found.collect()) == sorted([(7, 4)] + [(i, v) for i in range(50) if i != 7 for v in ((3,) if i % 2 else (1, 2))])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "_salt#" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
