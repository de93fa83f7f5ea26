"""Operators on documents: brute force on small tables with nulls, empties, repeats and ties."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.llm import decontaminate, language_id, line_dedup, ngram_join, packing, sequence_files, token_counts
from draftlake.llm.shared import new_folder
from draftlake.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node int, row string, comp string, n int"


def words(n, seed, start="w"):
    r = random.Random(seed)
    return " ".join(f"{start}{r.randrange(400)}" for _ in range(n))


def texts():
    base = words(120, 1)
    changed = base.split()
    changed[60] = "other"
    far = base.split()
    far[::6] = ["x"] * len(far[::6])
    long = words(6000, 2)
    rows = [base, base.upper(), " ".join(changed), " ".join(far), None, "", "   \n ", "one", "one", "one two three four", long, long + " end", words(80, 3), words(80, 4)]
    rows += [base + f" tail{i}" for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}", 0, 1, 2, "r", "c", 3) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (i, len(sets[i]), top(i)) for i in sets}


def test_ngram_components(docs):
    got = {r["doc_id"]: (r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute_components(list(enumerate(texts())))


def test_ngram_random_copies(spark):
    r = random.Random(5)
    bases = [words(r.randrange(3, 200), 100 + k).split() for k in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, max(1, len(w) // 20))):
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        rows.append((i, " ".join(w[: r.randrange(len(w) * 3 // 4, len(w) + 1)])))
    got = {x["doc_id"]: (x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_repeats_and_empty(spark):
    t = words(50, 9)
    rows = [(1, t), (1, t), (None, t), (2, None)]
    got = sorted((str(r[0]), r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 46, 1), ("1", 46, 1), ("2", 0, 2), ("None", 46, 1)]
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_screen_asks_for_no_more_than_links_have():
    for s in range(1, 150):
        have = []
        for t in range(1, 2 * s + 2):
            for both in range(1, min(s, t) + 1):
                if 100 * both >= 75 * (s + t - both):  # the elements of one side alone come first in its order
                    have.append(min(both, ngram_join.screened(s) - (s - both), ngram_join.screened(t) - (t - both)))
        assert max(1, ngram_join.screened(s) - s // 4 - ngram_join.SHORT.get(s, 0)) == max(1, min(have))


def test_ngram_screen_keeps_contained_sets(spark):
    rows = []
    for k, (small, large) in enumerate([(7, 9), (15, 20), (27, 36)]):
        text = " ".join(f"s{k}x{i}" for i in range(small + 4))
        rows.append((2 * k, text))
        for i in range(large - small):  # words whose new shingle is among the smallest hashes
            texts = [f"{text} e{k}x{i}y{n}" for n in range(300)]
            old = next(iter(ngram_join.W.shingle_sets([text])))
            new = [np.setdiff1d(s, old)[0] for s in ngram_join.W.shingle_sets(texts)]
            text = texts[int(np.argmin(new))]
        rows.append((2 * k + 1, text))
    got = {x["doc_id"]: (x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert [got[i][2] for i in range(6)] == [0, 0, 2, 2, 4, 4]


def test_ngram_near_misses_of_one_text(spark, monkeypatch):
    """Copies with up to nine changed words: most pairs are just above or below the threshold, and groups meet by their differences."""
    r = random.Random(8)
    base = words(140, 55).split()
    rows = [(k, " ".join(base)) for k in range(2)]
    for i in range(2, 260):
        w = list(base)
        for _ in range(r.choice((1, 3, 4, 5, 6, 7, 9))):
            w[r.randrange(len(w))] = f"n{r.randrange(2000)}"
        rows.append((i, " ".join(w[: len(w) - r.choice((0, 0, 20))])))
    met = []
    differences = ngram_join.by_differences
    monkeypatch.setattr(ngram_join, "by_differences", lambda members, *rest: met.append(members.count()) or differences(members, *rest))
    monkeypatch.setattr(ngram_join, "TRIES", (1,))
    monkeypatch.setattr(ngram_join, "FEW", 1)
    got = {x["doc_id"]: (x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and met[0] > 100


def test_differences_are_no_rows(spark, monkeypatch):
    """A member's differences travel in one row; only those by which it may meet others become rows, none in a group of copies that all link."""
    r = random.Random(9)
    base = words(150, 60).split()
    near = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(0, 60, 2)]
    far = [" ".join(f"f{i}x{r.randrange(3)}" if i in r.sample(range(60), 1) or i % 12 == 5 else w for i, w in enumerate(base)) for _ in range(40)]
    made, written = {}, ngram_join.save

    def counted(df, name, *rest):
        out = written(df, name, *rest)
        made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "save", counted)
    for texts, posts in ((near, False), (near + far, True)):
        sets = [(k, s) for k, s in enumerate(ngram_join.W.shingle_sets(texts))]
        frame = spark.createDataFrame([(k, len(s), s.tobytes(), ngram_join.marks(s)) for k, s in sets], "node long, size long, shingles binary, mark binary")
        members = spark.createDataFrame([(1, k) for k, _ in sets], "g long, node long")
        got = {x["node"]: x["comp"] for x in ngram_join.by_differences(members, frame, spark.createDataFrame([], "a long, b long")).collect()}
        want = brute_components([(k, t) for k, t in enumerate(texts)])
        assert {k: got.get(k, k) for k in range(len(texts))} == {k: v[2] for k, v in want.items()}
        assert made["differences"] == len(texts) and (made["posted"] > 0) == posts
        assert made["voters"] == ngram_join.VOTERS  # the base is counted of these alone


def test_allowances_cover_every_budget():
    rng = np.random.default_rng(1)
    np.seterr(over="ignore")
    s = np.unique(rng.integers(0, 1 << 62, 90, dtype=np.uint64))
    for band, high in ngram_join.bands_for(len(s)):
        whole, seg, less = ngram_join.signatures(s, band, high)
        total = (min(high - 1, len(s)) + len(s)) // 7 + 1
        v = ngram_join.allowances(whole, seg, less, total, rng.integers(0, 9, 2 * ngram_join.SKETCH))
        assert v.sum() >= total and v.max() <= 2


def brute_lines(rows):
    out, seen = {}, []
    for i, text in sorted(((i, t) for i, t in rows), key=lambda r: r[0]):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        kept, lines = [], text.split("\n")
        for line in lines:
            s = {w for w in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if w}
            if not (s and any(4 * len(s & y) >= 3 * len(s | y) for y in seen)):
                kept.append(line)
            seen.append(s)
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(docs, spark):
    r = random.Random(3)
    pool = [words(r.randrange(1, 30), 200 + k) for k in range(30)]
    rows = [(i, "\n".join(" ".join(w for w in r.choice(pool).split() if r.random() > 0.07) for _ in range(r.randrange(0, 6)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, doc int, key string, tie string")
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    assert set(line_dedup.dedup_lines(df).columns) == {"doc_id", "text", "doc", "key", "tie", "n_lines", "n_removed"}


def test_line_dedup_repeats_and_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "a b c"), (None, None)]
    got = sorted(map(str, ((r[0], r[1]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(1, ""), (1, ""), (1, "d e"), (None, "a b c"), (None, None)]))
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_dedup_clashing_names_and_blanks(spark):
    names = "doc_id long, text string, n_lines string, n_removed int, doc int, tie int, gone int, key int, sub int"
    rows = [(1, "a b\tc d\na  B c\x0bD", "u", 1, 2, 3, 4, 5, 6), (2, "x\n\t\n\x0c\nA b c d e", "v", 1, 2, 3, 4, 5, 6), (None, None, None, 1, 2, 3, 4, 5, 6)]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, names)).collect()}
    assert [(got[k]["text"], got[k]["n_lines"], got[k]["n_removed"]) for k in (1, 2, None)] == [("a b\tc d", 2, 1), ("x\n\t\n\x0c", 4, 1), (None, 0, 0)]
    assert got[1].asDict()["gone"] == 4 and got[1].asDict()["sub"] == 6


def test_line_dedup_of_any_length(spark):
    r = random.Random(8)
    pool = [words(r.randrange(2, 150), 600 + k) for k in range(40)]
    rows = [(i, "\n".join(" ".join(w if r.random() > 0.5 else "new" + w for w in r.choice(pool).split() if r.random() > share or r.random() > 0.5) for _ in range(4))) for i, share in enumerate([0.0, 0.1, 0.2, 0.3] * 5)]
    rows += [(50 + i, "\n".join(" ".join(w for w in r.choice(pool).split() if r.random() > share) for _ in range(6))) for i, share in enumerate([0.0, 0.05, 0.1, 0.13] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    assert 20 < sum(n for _, _, n in got.values()) < 360


def test_line_dedup_meets_few_lines(spark, monkeypatch):
    """Lines that share some rare tokens, though far from enough to match, do not all meet."""
    r, pool = random.Random(9), [f"w{k}" for k in range(400)]
    met, pairs = [], line_dedup._pairs
    monkeypatch.setattr(line_dedup, "_pairs", lambda joined: met.append(joined.count()) or pairs(joined))
    rows = [(i, " ".join(r.sample(pool, 100))) for i in range(300)]
    assert line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed > 0").count() == 0
    assert met and sum(met) < 3000


def test_leaks_exact_and_paraphrased(spark):
    items = [(k, f"Question {words(30, 40 + k, 'q')}. Answer {words(6, 60 + k, 'a')}.") for k in range(20)] + [(90, None), (91, "")]
    rows = [(i, words(200, 300 + i)) for i in range(60)]
    for k in range(10):
        w = items[k][1].split()
        if k % 2:
            w[3], w[9] = "changed", "too"
        rows[k] = (k, rows[k][1] + "\n" + " ".join(w).upper() + "\n" + rows[k][1])
    rows += [(200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(10)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.leaks(none, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_leaks_recall_by_item_length(spark):
    """Copies of 72 to 80 % of the words of items of 16 to 200 words, the others left out, replaced or doubled; 2,000 items."""
    r = random.Random(12)
    vocabulary = [f"v{k}" for k in range(4000)]
    often = [1 / (k + 20) for k in range(4000)]
    say = lambda n: r.choices(vocabulary, often, k=n)
    items, rows = [say(r.choice((16, 24, 40, 55, 67, 90, 120, 200))) for _ in range(2000)], []
    for k in range(240):
        w, kept = items[k], r.uniform(0.72, 0.8)
        gone = set(r.sample(range(len(w)), int((1 - kept) * len(w))))
        copy = [y for j, x in enumerate(w) for y in (say(k % 3) if j in gone else [x])]
        rows.append(say(r.randrange(40, 300)) + copy + say(r.randrange(40, 300)))

    def holds(d, i):
        item, h = (decontaminate.W.words(" ".join(x).encode(), decontaminate.W.MARKS)[2] for x in (items[i], rows[d]))
        span = int(decontaminate.SPAN * len(item))
        return any(decontaminate.common(item, h[k : k + span])[0] >= decontaminate.COVERED * len(item) for k in np.flatnonzero(np.isin(h, item)))

    docs, bench = (spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(y)], f"{c} long, text string") for c, y in (("doc_id", rows), ("item_id", items)))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()}
    want = {(k, k) for k in range(len(rows)) if holds(k, k)}
    assert len(want) == 240 and all(holds(*x) for x in got - want)
    assert sorted(len(items[i]) for _, i in want - got) == []


def test_singular_vectors_span_the_data(spark):
    items = decontaminate.Items([0, 1], [words(40, 1), words(40, 2)])
    docs = spark.createDataFrame([(i, words(60, i % 3)) for i in range(30)], "doc_id long, text string")
    sent = spark.sparkContext.broadcast(items)
    docs = decontaminate.encoded(docs, sent)
    count, n = decontaminate.frequencies(docs, sent)
    assert n == 90 and count.max() <= n
    v, s = decontaminate.singular_vectors(docs, sent, np.ones(decontaminate.TERMS))
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3) and np.all(np.diff(s) <= 1e-6)


def common_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))
        n, first, last = decontaminate.common(a, b)
        assert n == common_brute(a, b)
        assert n == 0 or common_brute(a, b[first : last + 1]) == n


def test_match_finds_the_tight_copy():
    """The traced case that swung for ever, then stretched and tight copies against all runs of the span."""

    def match(item, text):
        items = decontaminate.Items([0], [item])
        h = decontaminate.W.words(text.encode(), decontaminate.W.MARKS)[2]
        return decontaminate._match(items, 0, h, 0, len(h)), h, items.words[0]

    part = [f"x{k}" for k in range(31)]
    for k, w in ((0, "a"), (1, "b"), (10, "c"), (12, "a"), (13, "b"), (14, "c"), (30, "d")):
        part[k] = w
    assert match("a b c d", " ".join(part))[0] == (0.75, 12, 3)
    r = random.Random(4)
    found = 0
    for _ in range(300):
        item = [f"i{r.randrange(9)}" for _ in range(r.randrange(3, 11))]
        text = []
        for _ in range(r.randrange(1, 4)):
            gap = r.choice((0, 0, 1, 4))
            for w in item:
                text += [w] * (r.random() < 0.9) + [f"x{r.randrange(9)}" for _ in range(r.randrange(gap + 1))]
        got, h, hashes = match(" ".join(item), " ".join(text))
        span = int(decontaminate.SPAN * len(item))
        most = max(common_brute(hashes, h[k : k + span]) for k in range(len(h))) if len(h) else 0
        assert (got[0] if got else 0) == (most / len(item) if most >= decontaminate.COVERED * len(item) else 0)
        if got:
            found += 1
            assert got[2] <= span and common_brute(hashes, h[got[1] : got[1] + got[2]]) == most
    assert 50 < found < 300


def brute_best_fit_is_valid(rows, lengths):
    held, size = {}, {}
    for r in rows:
        held.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"]))
        size[r["bin_id"]] = (r["bin_tokens"], r["bin_length"])
    for b, parts in held.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size[b][0] <= size[b][1] == min(x for x in lengths if x >= at)
    return held


def test_packing(docs, spark):
    lengths = (64, 128, 512)
    rows = packing.pack(docs, lengths, 8).collect()
    brute_best_fit_is_valid(rows, lengths)
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {i: len((t or "").split()) + 1 for i, t in enumerate(texts())}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert len(twice) == 3


def test_packing_beats_one_length():
    rng = np.random.default_rng(4)
    count = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(rng.geometric(0.004, 5000), 1024), return_counts=True), strict=True)}
    plan = packing.make_plan(count, (256, 512, 1024), 16)
    filled = sum(s * n for s, n in count.items())
    assert plan.cost < 1.15 * (filled + 16 * plan.bins) and (plan.used <= plan.length).all()


def test_sequences_round_trip(docs, spark):
    folder = new_folder(spark, "seq")
    files = sequence_files.write_sequences(docs, folder, "byte_bpe_50k.json", 2, 32)
    t = encoder("byte_bpe_50k.json").tokenizer
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts())}
    at, want = 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        at += len(ids[i])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in sequence_files.read_documents(files).collect()}
    assert got == want
    f = files.orderBy("part").first()
    file = sequence_files.SequenceFile(f["uri"])
    seq, mask = file.sequence(0)
    first = np.concatenate([ids[i] for i in sorted(ids)])[:32]
    assert len(seq) == 32 and mask[: len(first)].all() and seq[: len(first)].tolist() == first.tolist() and seq.base is not None
    assert sequence_files.token_sequences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_encoder_equals_library():
    e = encoder("byte_bpe_50k.json")
    odd = ["a<|endoftext|>b", "  x  \n\n y ", "", "İ ﬃ 漢字 12ab's", "   z", "  ", "a\n", "a \n", "\n a", "x  12 34!! b?", " \t b", "é çà Ñ", "\x00a", None]
    for text, ids in zip(odd, e.encode(odd), strict=True):
        assert ids.tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_totals(docs, spark):
    n = lambda t: len(encoder("byte_bpe_50k.json").tokenizer.encode(t, add_special_tokens=False).ids)
    first, want = {}, {}
    for i, t in enumerate(texts()):
        first.setdefault(t or "", i)
        if first[t or ""] == i:
            key = (f"s{i % 2}", ("en", "fr", None)[i % 3])
            a, b = want.get(key, (0, 0))
            want[key] = (a + 1, b + n(" ".join((t or "").split())))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.document_totals(docs).collect()}
    assert got == want


def test_commits_count_once(spark):
    store = token_counts.TokenTotals(spark, new_folder(spark, "totals"))
    assert store.totals().collect() == []
    schema = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    batch = spark.createDataFrame([("insert", "s", None, "t", 5, None), ("insert", "s", None, "t", None, None), ("revise", "s", None, "t", 7, 5)], schema)
    assert store.commit("a", batch) and not store.commit("a", batch)
    assert [tuple(r) for r in store.totals().collect()] == [("s", None, "t", 2, 7)]
    store.commit("b", spark.createDataFrame([("delete", "s", None, "t", 7, None), ("delete", "s", None, "t", 0, None)], schema))
    assert store.totals().collect() == []
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("c", spark.createDataFrame([("odd", "s", None, "t", 7, None)], schema))


def test_commits_without_the_markers_of_a_cluster(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store = token_counts.TokenTotals(spark, new_folder(spark, "totals"))
        batch = spark.createDataFrame([("insert", "s", "en", "t", 5, None)], "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
        assert store.commit("a", batch) and not store.commit("a", batch)
        other = token_counts.TokenTotals(spark, store.folder)  # a second writer, and one that is stopped before its commit
        with pytest.raises(Exception, match="stopped"):
            other.commit("b", batch.withColumn("n_tokens", F.raise_error("stopped").cast("long")))
        assert [tuple(r) for r in other.totals().collect()] == [("s", "en", "t", 1, 5)]
        assert other.commit("b", batch) and [r["n_docs"] for r in store.totals().collect()] == [2]
    finally:
        conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def test_language_id(spark):
    vocab = {"aa": "the of and with that from which house river", "bb": "der und das mit nicht straße über fluss haus", "cc": "le de et avec dans maison rivière été que"}
    r = random.Random(1)
    say = lambda x, n: " ".join(r.choice(vocab[x].split()) for _ in range(n))
    rows = [(i, say(x, 40), x) for i, x in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, say("aa", 20) + " " + say("bb", 5), None), (904, "zzzz", None)]
    df = spark.createDataFrame([(*x, "extra", 1.0) for x in rows], "doc_id long, text string, lang string, lang_hint string, weight double")
    got = {x["doc_id"]: x for x in language_id.languages(df).collect()}
    assert len(got) == len(rows)
    for i, t, x in rows[:120]:
        assert got[i]["lang_pred"] == x and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "aa" and got[903]["score"] < got[0]["score"]
    assert {x["lang_pred"] for x in language_id.languages(df.withColumn("lang", df["lang_hint"].substr(9, 1)).limit(0)).collect()} == set()


def test_forward_backward_by_enumeration():
    import itertools

    f = language_id.Field(["a", "b"], {"a": [], "b": []})
    rng = np.random.default_rng(3)
    f.moves = rng.normal(size=(2, 2)).astype(np.float32)
    e = rng.normal(size=(1, 4, 2))
    for size in (1, 3, 4):
        weight = np.zeros((size, 2))
        for path in itertools.product((0, 1), repeat=size):
            w = np.exp(sum(e[0, i, y] for i, y in enumerate(path)) + sum(f.moves[a, b] for a, b in itertools.pairwise(path)))
            for i, y in enumerate(path):
                weight[i, y] += w
        want = weight / weight.sum(axis=1, keepdims=True)
        assert np.allclose(f.marginals(e, np.array([size]))[0, :size], want, atol=1e-6)
        assert np.allclose(f.posteriors(e, np.array([size]))[0][0, :size], want, atol=1e-6)


def test_language_id_one_label_and_none(spark):
    rows = [(i, f"house river {i} the", "aa" if i % 2 else None) for i in range(20)] + [(50, "??", "aa"), (None, "river", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in language_id.languages(df).collect() if x["doc_id"] != 50} == {"aa"}
    none = language_id.languages(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {(x["lang_pred"], x["score"], len(x["spans"])) for x in none} == {("und", 0.0, 0)} and len(none) == len(rows)


def test_language_spans_and_clashing_names(spark):
    vocab = {"aa": "the of and with that from which house river", "bb": "der und das mit nicht straße über fluss haus"}
    r = random.Random(3)
    say = lambda x, n: " ".join(r.choice(vocab[x].split()) for _ in range(n))
    field = language_id.fit([(say(x, 40), x) for x in ("aa", "bb") * 60])
    df = spark.createDataFrame([(1, say("aa", 30) + " " + say("bb", 25), 0.5, "x"), (2, say("bb", 200), 0.5, "y"), (3, None, None, None)], "doc_id long, text string, score double, lang_pred string")
    got = {x["doc_id"]: x for x in language_id.predict(df, field, spans=True).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(0, 30, "aa"), (30, 25, "bb")]
    assert [tuple(s) for s in got[2]["spans"]] == [(0, 200, "bb")] and got[3]["lang_pred"] == "und" and got[3]["spans"] == []


def test_word_features_by_brute_force():
    """Affixes, pairs and triples found for all words at once are those of each word alone."""
    field = language_id.Field(["a", "b"], {"a": ["straße"], "b": ["straße", "été"]})
    words = ["a", "Ab", "été", "STRASSE", "straße", "Δοκιμή", "x" * 70]
    number, start = field.features(words)
    for w, x in zip(words, np.split(number, start[1:]), strict=True):
        n = len(w.lower())
        assert sorted(x.tolist()) == sorted(field.features([w])[0].tolist())
        assert len(x) == max(0, n - 1) + max(0, n - 2) + 2 * min(3, n) + len(field.lexicon.get(w.lower(), ()))
