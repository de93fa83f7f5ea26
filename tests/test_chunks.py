"""Chunks against a plain recursive loop, on texts of nested separators."""

import random
import re

from pyspark.sql import functions as F

from draftlake.operators import chunks as C
from draftlake.operators import documents as D


def merged(parts, size, overlap):
    """Joins parts one by one; the tail of a chunk that the overlap allows begins the next."""
    out, held = [], []
    length = lambda: sum(map(len, held))
    for p in parts:
        if held and length() + len(p) > size:
            out.append("".join(held))
            while held and (length() > overlap or length() + len(p) > size):
                held = held[1:]
        held = held + [p]
    return out + (["".join(held)] if held else [])


def looped(text, size, overlap, separators, before):
    """Cuts at the first separator found, then each long part by the rest of the separators."""
    k = next((k for k, s in enumerate(separators) if re.search(s, text)), None)
    if k is None:
        parts, rest = [text], ()
    else:
        split, rest = re.split(f"({separators[k]})", text), separators[k + 1 :]
        if before:
            parts = [split[0]] + [a + b for a, b in zip(split[1::2], split[2::2], strict=True)]
        else:
            parts = [a + b for a, b in zip(split[::2], split[1::2] + [""], strict=True)]
    out, run = [], []
    for p in (p for p in parts if p):
        if len(p) < size:
            run.append(p)
        else:
            out += merged(run, size, overlap) + (looped(p, size, overlap, rest, before) if rest else [p])
            run = []
    return out + merged(run, size, overlap)


def nested(r):
    pieces = ["\n\n", "\n", "。", "！", ". ", "? ", "；", "; ", "，", ", ", " ", "长句子", "word", "x" * 30, "\n\n\n", "”"]
    return "".join(r.choice(pieces) * r.choice((1, 1, 1, 2)) for _ in range(r.randrange(0, 120)))


def test_equal_to_the_loop():
    r = random.Random(7)
    for _ in range(1500):
        text, size = nested(r), r.choice((5, 20, 50, 200))
        overlap = r.randrange(0, size)
        want = [re.sub(r"\n{2,}", "\n", c.strip()) for c in looped(text, size, overlap, C.PROSE, False) if c.strip()]
        assert C.cut(text, size, overlap, [re.compile(s) for s in C.PROSE]) == want, (text, size, overlap)


def test_over_size_only_without_separators():
    r = random.Random(8)
    marks = [re.compile(s) for s in C.PROSE]
    for _ in range(300):
        text = nested(r)
        for a, b in C.chunk_spans(text, 25, 10, marks):
            assert b - a <= 25 or all(len(list(C._pieces(text, a, b, m, False))) == 1 for m in marks)
    plain = [re.compile(s) for s in C.PLAIN]
    assert all(b - a <= 7 for _ in range(200) for t in [nested(r)] for a, b in C.chunk_spans(t, 7, 0, plain, True))


def test_every_character_is_in_a_span():
    r = random.Random(9)
    for _ in range(200):
        text = nested(r)
        spans = list(C.chunk_spans(text, 40, 15, [re.compile(s) for s in C.PROSE]))
        assert {k for a, b in spans for k in range(a, b)} == set(range(len(text)))


def test_long_text_in_a_short_time():
    import time

    text = ("wort " * 40 + "。\n") * 5000  # 1 MB
    start = time.perf_counter()
    assert len(C.cut(text, 200, 50, [re.compile(s) for s in C.PROSE])) >= 5000
    assert time.perf_counter() - start < 20


def test_columns(spark):
    rows = [(1, "a. b. c"), (2, None), (3, ""), (4, "  \n"), (5, "Ein Satz。Noch einer！" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", D.chunks(F.col("text"), 20, 5).alias("c"))
    got = {r["doc_id"]: r["c"] for r in df.collect()}
    assert got[1] == ["a. b. c"] and got[2] is None and got[3] == got[4] == [] and all(len(c) <= 20 for c in got[5])


def test_small_to_big_and_back(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(300))) for k in range(5)] + [(9, None)], "doc_id long, text string")
    parents = D.chunk_table(docs, D.chunks(F.col("text"), 510, 200)).select("doc_id", "seq", "chunk_id", "chunk")
    small = D.small_to_big(parents, 64)
    whole = {r["chunk_id"]: r["chunk"] for r in parents.collect()}
    rows = small.collect()
    assert {r["parent_id"] for r in rows} == set(whole) and all(r["chunk"] in whole[r["parent_id"]] and len(r["chunk"]) <= 64 for r in rows)
    hits = spark.createDataFrame([(1, rows[0]["parent_id"], 3), (1, rows[0]["parent_id"], 1), (1, rows[-1]["parent_id"], 2)], "query_id long, parent_id string, rank int")
    back = sorted((r["place"], r["chunk"]) for r in D.parents_of(hits, parents).collect())
    assert back == [(1, whole[rows[0]["parent_id"]]), (2, whole[rows[-1]["parent_id"]])]
