"""Numbering and whole texts on small cases."""

import random
from datetime import datetime, timedelta

import pytest

from draftlake.operators import rows as R
from draftlake.plans import registry
from draftlake.plans.fixtures import frame

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("ranges", [2, 5, 64])
def test_newest_first(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, None if i % 17 == 0 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(600))) for i in range(300)]
    rows += [(1000 + i, datetime(2024, 1, 1, 3)) for i in range(150)]  # one time holds a third of the rows
    got = R.newest_first(spark.createDataFrame(rows, "id bigint, ts timestamp_ntz"), "ts", "id", ranges)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(2024, 1, 1)).timestamp(), r[0]))
    assert {r.id: r.place for r in got.collect()} == {i: k for k, (i, _) in enumerate(want, 1)}
    none = R.newest_first(spark.createDataFrame([], "id bigint, ts timestamp_ntz"), "ts", "id", ranges)
    assert none.collect() == []
    nulls = R.newest_first(spark.createDataFrame([(2, None), (1, None)], "id bigint, ts timestamp_ntz"), "ts", "id", ranges)
    assert {r.id: r.place for r in nulls.collect()} == {1: 1, 2: 2}


def test_text_boxes_hold_whole_texts(spark):
    """The parts of each document, in the order of its boxes, are its text."""
    texts = {r.doc_id: r.text for r in frame(spark, DATA, "documents").select("doc_id", "text").collect()}
    parts: dict[int, str] = {}
    for r in sorted(frame(spark, DATA, "txt").select("ent_id", "text").collect()):
        doc = r.ent_id % len(texts)
        parts[doc] = parts.get(doc, "") + r.text
    assert parts == texts


def test_span_threshold_reaches_the_end(spark):
    got = {r.doc_id: r.answers for r in registry.QUERIES["span_threshold"](spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in frame(spark, DATA, "documents").select("doc_id", "text").collect()}
    want = {}
    for doc, text in texts.items():
        spans = dict.fromkeys(text[s : s + 6] for s in range(0, len(text), 6) if (doc * 7 + s) % 10 / 10.0 > 0.3)
        if spans:
            want[doc] = "|".join(spans)
    assert got == want
