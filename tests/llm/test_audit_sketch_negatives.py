"""Source divergence, sketches and hard negatives by brute force, on small tables with nulls, empties, repeats and ties."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from draftlake.llm import hard_negatives, minhash, sorted_lists, source_audit

DOCS = "doc_id long, text string, lang string, source string, value long, term string, shard int, node int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Source divergence


def brute_divergence(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        share = lambda n, total: 1 + (10**9 * (n + 5)) // (total + 5 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            q = {t: share(whole[t], sum(total.values())) for t in kept}
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(over[:top], 1)]
    return sorted(out)


def audit_rows(n=400, seed=5):
    r = random.Random(seed)
    vocabulary = [f"wort{a}{b}" for a in "abcdefgh" for b in "xyzäß"] + ["été", "Été", "中文", "a\x80b", "x y"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(vocabulary)[:: r.choice((1, 1, 1, -1))].replace("w", r.choice("wW")) + r.choice([" ", ", ", "\n", "5", "_", "\x00", " "]) for _ in range(r.randrange(0, 30)))
        rows.append((text, r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s2", "s3", "é", None, "s10"])))
    return rows + [(None, "fr", "s1"), ("", "fr", None), ("only one", "it", "s1"), ("only one", "it", "s1"), ("the " * 5000, "en", "s2"), (None, None, None)]


def audit(spark, rows, **more):
    df = spark.createDataFrame([(k, *r, 1, "x", 2, 3) for k, r in enumerate(rows)], DOCS).repartition(3)
    return sorted(tuple(r) for r in source_audit.divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_by_brute_force(spark):
    rows = audit_rows()
    want = brute_divergence(rows, 12, 5)
    assert audit(spark, rows, least_docs=12, top=5) == want
    # Blocks that spill after a few entries, chunks of a few terms: many runs to merge.
    assert {part for _, _, part, *_ in want} == {"pair", "term"}


def test_spilled_runs_and_many_sources(spark, monkeypatch):
    # Workers import the module anew, so what is set here holds on the driver's side of a test of the functions alone.
    rows = audit_rows(200, 6)
    monkeypatch.setattr(source_audit, "CHUNK", 3)
    for most in (1, 40, 10**9):
        chunks, block, groups = [], source_audit.Block(), 0
        for text, lang, source in rows:
            block.add(lang or "", source or "", text)
            if block.entries >= most:
                chunks += block.runs(7)
                block = source_audit.Block()
                groups += 1
        chunks += block.runs(7)
        chunks.sort(key=lambda c: (c["shard"], c["lang"].encode(), c["first"]))
        count, docs = defaultdict(Counter), defaultdict(Counter)
        for text, lang, source in rows:
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
            for t in terms:
                count[lang or "", t][source or ""] += 1
            docs[lang or ""].update(set(terms))
        got = {(lang, t.decode()): of for lang, t, of in source_audit.merged(iter(chunks), 4)}
        assert got == {k: dict(of) for k, of in count.items() if docs[k[0]][k[1]] >= 4}
        assert len(chunks) > 20
    assert audit(spark, rows, least_docs=4, top=50, run_entries=30) == brute_divergence(rows, 4, 50)


def test_pairs_of_more_sources_than_a_square_holds(monkeypatch):
    monkeypatch.setattr(source_audit, "SQUARE", 4)
    monkeypatch.setattr(source_audit, "PAIRS", 50)
    r, want, got = random.Random(1), Counter(), Counter()
    sums = source_audit.PairSums("en")
    for _ in range(60):
        names = r.sample([f"s{k}" for k in range(9)], r.randrange(1, 9))
        p, p0 = (np.array([r.randrange(1, 99) for _ in names]) for _ in range(2))
        sums.add(names, p, p0)
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                want[a, b] += int(abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j]))
        if r.random() < 0.1:
            for batch in sums.rows():
                for x in batch.to_pylist():
                    got[x["source"], x["other"]] += x["value"]
    for batch in sums.rows():
        for x in batch.to_pylist():
            got[x["source"], x["other"]] += x["value"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_terms_of_a_long_text(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 64)
    text = "Ab é中, c_d" * 300
    assert [t.decode() for part in source_audit.text_terms(text) for t in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def test_no_documents(spark):
    assert audit(spark, []) == []


# Sketches


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_duplicates(rows):
    sets, up = {i: shingles(t, 3) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 85 * len(x | y):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def duplicate_rows():
    r = random.Random(11)
    some = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    rows = [None, "", " \n\t", "one", "ONE", "one two", "one two three four", "a b c d"]
    for n in (3, 8, 22, 40, 90, 127, 128, 131, 160, 400, 2500):
        base = some(n)
        rows += [" ".join(base), " ".join(base).upper()]
        for changes in range(1, 9):  # around the threshold on both sides
            changed = list(base)
            for k in r.sample(range(n), min(n, max(1, n * changes // 160))):
                changed[k] = "other"
            rows.append(" ".join(changed))
            rows.append(" ".join(base + some(max(1, n * changes // 50))))
    common = some(60)
    rows += [" ".join(common + some(60)) for _ in range(40)]  # one passage in many texts
    centre = some(140)
    for _ in range(60):  # near copies that are mostly too far from each other
        near = list(centre)
        for k in r.sample(range(140), 6):
            near[k] = some(1)[0]
        rows.append(" ".join(near))
    return [(k, t) for k, t in enumerate(rows)]


def test_near_duplicates_by_brute_force(spark):
    rows = duplicate_rows()
    df = spark.createDataFrame([(k, t, None, "s", 1, "x", 2, 3) for k, t in rows], DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    want = brute_duplicates(rows)
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(rows) - 60


def test_crowded_lists_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 0)  # every open list is crowded
    monkeypatch.setattr(minhash, "TRIES", (1,))
    rows = duplicate_rows()[-110:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_duplicates(rows)


def test_sketches_of_a_union():
    r = np.random.default_rng(3)
    lost = 0
    for _ in range(400):
        n = int(r.integers(1, 900))
        both = r.integers(0, 1 << 63, n, dtype=np.uint64)
        own = int(15 * n / 85)
        x, y = (np.unique(np.concatenate([both, extra])) for extra in np.split(r.integers(0, 1 << 63, own // 2 * 2, dtype=np.uint64), 2))
        if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
            lost += not minhash.union_estimate(x[: minhash.K], y[: minhash.K])
    assert lost == 0 and 70 < minhash.SURE < 95
    far = r.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    assert not minhash.union_estimate(*np.sort(far)[:, : minhash.K])
    assert [minhash.least_shared(s) for s in (1, 2, 7, 20, 90, 5000)] == [1, 2, 6, 17, 77, minhash.SURE]


def test_rows_without_id_and_repeats(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d e"), (5, "x y z"), (7, "x y z"), (None, "other text here")]
    got = sorted(map(str, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(["Row(doc_id=None, component_id=None, kept=True)"] * 3 + ["Row(doc_id=5, component_id=5, kept=True)"] * 2 + ["Row(doc_id=7, component_id=5, kept=False)"])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, rank int, id long, anchor string, values int, block int, length int"


def brute_negatives(rows, every, scale=256):
    whole = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((vec_id, [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(scale * x)) if abs(scale * x) < 1e300 else (1 << 63) * (1 if x > 0 else -1))) for x in v], label))
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for a_id, a, a_label in whole:
        if a_id % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v, strict=True)), i, label) for i, v, label in whole if i != a_id and len(v) == len(a)))
        for p, p_id, _ in [x for x in scored if x[2] == a_label][:5]:
            fits = [(s, i) for s, i, label in scored if label != a_label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a_id, p_id, k, i, clamp(-p), clamp(-s)) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=5):
    df = spark.createDataFrame([(*r, 1, 2, "a", 3, 4, 5) for r in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, every=every).collect())


def vector_rows(n, d, seed, spread=0.4, labels=3):
    r = np.random.default_rng(seed)
    centre = r.normal(0, spread, (labels, d))
    return [(k, (r.normal(0, spread, d) + centre[k % labels] * 0.7).tolist(), k % labels) for k in range(n)]


def test_hard_negatives_by_brute_force(spark):
    rows = vector_rows(150, 8, 1)
    rows += [(200, None, 1), (205, [None] + [0.0] * 7, 1), (210, [float("nan")] + [1.0] * 7, 0), (215, [float("inf")] * 8, 0), (None, [0.1] * 8, 1), (220, [0.1] * 8, None)]
    rows += [(225, [0.2, 0.1], 0), (226, [0.3, 0.1], 0), (227, [0.2, 0.05], 1), (230, [], 0), (231, [], 0), (232, [], 1)]
    rows += [rows[10], (301, rows[10][1], 2), (302, rows[10][1], 1), (303, rows[10][1], 1)]  # repeats and ties
    got = mined(spark, rows)
    assert got == brute_negatives(rows, 5) and len(got) > 100
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 0)]) == []


@pytest.mark.parametrize("unit", [1e-3, 40.0, 1e6, 1e15, 1e300])
def test_numbers_of_any_width(spark, unit):
    rows = [(k, [x * unit for x in v], label) for k, v, label in vector_rows(60, 6, 2)]
    assert mined(spark, rows) == brute_negatives(rows, 5)


def test_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rows = vector_rows(200, 5, 3, labels=4)
    assert mined(spark, rows) == brute_negatives(rows, 5)


def test_packed_products():
    r = np.random.default_rng(4)
    for low, high in ((-3, 4), (-130, 130), (0, 1), (-(1 << 20), 1 << 20), (-(1 << 40), 1 << 40), (-(1 << 63), (1 << 63) - 1), (1 << 50, (1 << 50) + 3), (7, 8)):
        for m, n, d in ((1, 1, 1), (3, 7, 64), (5, 10, 3), (0, 4, 2), (2, 0, 2), (2, 3, 0)):
            a, x = (r.integers(low, high, (k, d), dtype=np.int64, endpoint=False) for k in (m, n))
            want = a.astype(object) @ x.astype(object).T if d else np.zeros((m, n), object)
            assert (hard_negatives.packed_products(a, x) == want).all()


def test_top_scores_beyond_any_decimal(spark):
    for n in (2, 3, 64):
        rows = [(0, [1e300] * n), (1, [1e300] * n), (2, [1e300] * (n - 1) + [-1e300]), (3, [-1e300] * n), (4, [0.0] * n)]
        got = sorted(sorted_lists.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
        ends = [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1 if n > 2 else None), (0, 3, 4, 0), (0, 4, 3, -(1 << 63))]
        if n == 2:  # the two ends of long do not quite cancel
            ends[1] = (0, 2, 4, 0)
            ends[2] = (0, 3, 2, -((1 << 63) - 1))
        assert [tuple(r) for r in got] == ends


def test_labels_as_a_column(spark):
    rows = vector_rows(60, 6, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    changed = [(k, v, (c + 1) % 3 if k % 7 == 0 else c) for k, v, c in rows]
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(df, every=5, label=label).collect()) == brute_negatives(changed, 5)


def test_tasks_of_block_pairs_are_bounded(spark, monkeypatch):
    """Many blocks of candidates and queries meet in a bounded number of tasks, however many pairs they make, with the same results."""
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    whole = sorted(sorted_lists.top_k(df, every=2).collect()), sorted(hard_negatives.hard_negatives(df, every=2).collect())
    for module, blocks in ((sorted_lists, ("BLOCK", "QUERY_BLOCK")), (hard_negatives, ("BLOCK", "ANCHOR_BLOCK"))):
        for name in blocks:
            monkeypatch.setattr(module, name, 8)
    tasks, dealt = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, *a, **k: tasks.append(df.rdd.getNumPartitions()) or dealt(df, *a, **k))
    assert whole[0] == sorted(sorted_lists.top_k(df, every=2).collect())
    assert whole[1] == sorted(hard_negatives.hard_negatives(df, every=2).collect())
    assert len(tasks) == 3 and max(tasks) <= 16
