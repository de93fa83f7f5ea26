"""Operators on pages and vectors, and the pipeline."""

import base64
import hashlib
import json
import random

import numpy as np
import pytest

from draftlake.llm import main_text, sorted_lists, stages, warc
from draftlake.llm.shared import new_folder


def test_minimum_cut_by_enumeration():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 8)
        balance = [r.randrange(-9, 10) for _ in range(n)]
        edges = {(a, b): r.randrange(0, 7) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4}

        def cost(keep, balance=balance, edges=edges):
            return sum(b if b > 0 and not k else -b if b < 0 and k else 0 for b, k in zip(balance, keep, strict=True)) + sum(w for (a, b), w in edges.items() if keep[a] != keep[b])

        assert cost(main_text.minimum_cut(balance, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><a href="/">Home</a> <a href="/b">News</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to improve this site. Accept all of them.</div>
<main><h1>A &amp; B</h1><p>First paragraph with   some words,
and more of them here.<br>Next line &eacute;.</p><aside class="sidebar"><p>Read also our other long stories here.</p></aside>
<p>Second <a href="x">paragraph</a> ends &lt;here&gt; with enough words in it.</p><div class="ad">Buy now, the best offer of the year!</div>
<form><label>Mail</label><input><button>Send</button></form></main>
<section id="comments"><p>I think that this is a really great article, thank you.</p></section><footer>&copy; 2024 Us</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "A & B\nFirst paragraph with some words, and more of them here. Next line é.\nSecond paragraph ends <here> with enough words in it."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p>") == ""
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long article.</p>" for i in range(3000)) + "</article>"
    assert main_text.main_text(long).count("\n") == 2999
    for broken in ("<", "<p", "<!-- x", "<script>", "a < b", "<p title='>'>x</p>", "</p></div>", "<a href=x"):
        main_text.main_text(broken)


def test_marks_of_the_page_hide_no_article():
    said = "This paragraph tells a long story with many words in it, and it ends here."
    body = f"<article><p>{said}</p></article>"
    for page in (
        f"<html class='no-js hidden'><body style='overflow:hidden' class='has-sidebar'>{body}</body></html>",
        f"<div class='overflow-hidden'>{body}</div>", f"<div style='overflow: hidden'>{body}</div>", f"<div aria-hidden='false'>{body}</div>",
        f"<div data-note='hidden display:none'>{body}</div>", f"<div class='sidebar-right'>{body}</div>", f"<main><div class='sidebar'>{body}</div></main>",
        *(f"<article class='post {c}'><p>{said}</p></article>" for c in ("no-sidebar", "has-comments", "with-sidebar", "overflow-hidden", "no-header-ad")),
    ):
        assert main_text.main_text(page) == said, page
    for gone in ("<p hidden>", "<p HIDDEN=''>", "<p style='color:red; display: none'>", "<p aria-hidden=true>", "<p class='sidebar'>", "<div class='comments'><article>"):
        assert main_text.main_text(f"{body}{gone}{said} Again.") == said, gone
    assert main_text.main_text(f"<div id=comments>{body}</div>") == ""
    formula = "<math><semantics><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a tex</annotation></semantics></math>"
    assert main_text.main_text(f"<article><p>{said[:-1]}: {formula}.</p></article>") == f"{said[:-1]}: a=b."


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)


def test_unclosed_elements_take_linear_time():
    import time

    start = time.perf_counter()
    assert main_text.blocks_of("<p>" + "<option>a " * 60_000)
    assert time.perf_counter() - start < 5


def test_warc_ids_and_markup():
    a, b = warc.response(1, "http://x", "<p>one</p>"), warc.response(1, "http://x", "<p>two</p>")
    ids = [warc.parse(r)[0]["WARC-Record-ID"] for r in (a, b, *warc.derive(a), *warc.derive(b))]
    assert len(set(ids)) == 6 and warc.response(1, "http://x", "<p>one</p>") == a
    assert warc.plain_text('<p title="a>b">text &amp; more</p><p>second<script>x < 1') == "text & more\nsecond"


def test_warc_derivatives(spark):
    rows = [(1, "http://a/ b", PAGE, 1), (2, None, None, 2), (1, "http://a/ b", PAGE, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record int")
    sources = warc.responses(pages)
    got = warc.fields(warc.derivatives(sources)).collect()
    assert len(got) == 6
    heads = {r["page_id"]: warc.parse(bytes(r["record"])) for r in sources.collect()}
    for r in got:
        head, block = heads[r["page_id"]]
        payload = block.partition(b"\r\n\r\n")[2]
        assert r["refers_to"] == head["WARC-Record-ID"] and r["target_uri"] == head["WARC-Target-URI"]
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["content"].encode()).digest()).decode()
        assert r["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["content_length"] == len(r["content"].encode())
    meta = json.loads(next(r["content"] for r in got if r["record_type"] == "metadata" and r["page_id"] == 1))
    assert meta["title"] == "T" and meta["links"][:3] == ["/", "/b", "1"] and meta["source"]["WARC-Target-URI"] == "http://a/%20b"
    files = warc.write_warc(warc.derivatives(sources).coalesce(1), new_folder(spark, "warc")).collect()
    import gzip

    data = gzip.open(files[0]["uri"].removeprefix("file://")).read()
    assert data.count(b"WARC/1.1\r\n") == 6 == sum(f["n_records"] for f in files)
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []


@pytest.mark.parametrize("kind", ["random", "ties", "few"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(5)
    n = 3 if kind == "few" else 400
    v = rng.normal(size=(n, 6)) if kind != "ties" else np.ones((n, 6)) * rng.integers(0, 2, (n, 1))
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v.tolist())]
    rows += [(1000, None, "x"), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (1100, [float("nan")] * 6, "x"), (1150, [float("inf")] * 6, "x"), (1200, [1.0], "x")]
    got = sorted_lists.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), every=50).collect()
    e = {i: np.floor(256 * np.array(x)).astype(int) for i, x, _ in rows[:n]}
    want = set()
    for q in (i for i in e if i % 50 == 0):
        best = sorted(((-int(e[q] @ e[c]), c) for c in e if c != q))[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert sorted_lists.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_top_k_large_empty_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(sorted_lists, "BLOCK", 40)
    monkeypatch.setattr(sorted_lists, "QUERY_BLOCK", 3)
    v = [[float(y) for y in z] for z in rng.normal(size=(300, 5)) * 10.0 ** rng.integers(0, 9, (300, 1))]
    v[7], v[8] = [1e6, 2.0, 0.0, 0.0, 0.0], [3e15, -3e15, 3e15, 1e15, 1.0]
    rows = [(i, x) for i, x in enumerate(v)] + [(k, []) for k in (350, 351, 400)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in sorted_lists.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    e = {i: [int(np.floor(256 * y)) for y in x] for i, x in rows}
    top = (1 << 63) - 1
    for q in (i for i in e if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(e[q], e[c], strict=True)), c) for c in e if c != q and len(e[c]) == len(e[q]))[:5]
        for k, (s, c) in enumerate(best):
            assert got.pop((q, k + 1)) == (c, min(top, max(-top - 1, -s)))
    assert not got


def test_lists_are_read_in_part_where_bounds_allow():
    rng = np.random.default_rng(7)
    x = (256 * rng.normal(size=(3000, 8)) * np.array([40, 10, 3, 1, 1, 1, 1, 1])).astype(np.int64)
    x[:6] *= 4
    read: list[int] = []
    qi, xi, score = sorted_lists.best_of_block(x[:20], np.arange(20), x, np.arange(3000), 5, read)
    assert min(read) < x.size / 2 and max(read) <= x.size
    for q in range(20):
        want = sorted((-int(x[q] @ x[c]), c) for c in range(3000) if c != q)[:5]
        assert [(-score[k], int(xi[k])) for k in np.flatnonzero(qi == q)] == want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    vocab = {x: [f"{x}{k}{y}" for k in "abcdefghij" for y in ("tion", "ment", "ing")] for x in ("th", "ouv", "sch")}
    say = lambda x, n: "\n".join(" ".join(r.choice(vocab[x]) + str(r.randrange(99)) * (r.random() < 0.5) for _ in range(20)) for _ in range(n))
    langs = {"th": "en", "ouv": "fr", "sch": "de"}
    rows = []
    for i in range(90):
        x = list(langs)[i % 3]
        rows.append([i, say(x, 6), langs[x], "s", 0])
    item = " ".join(f"item{k}" for k in range(30))
    rows[10][1] += "\n" + item
    rows[20][1] = rows[1][1]
    rows[30][1] = "12 34 !!"
    rows[40][1] = None
    docs = spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, f), gone in zip(corpus_pipeline.STAGES, ({30, 40}, {20}, set(), {10}), strict=False):
        before = {x["doc_id"] for x in kept.select("doc_id").collect()}
        kept = f(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        assert before - {x["doc_id"] for x in kept.select("doc_id").collect()} == gone, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in out.collect()} == set(range(90)) - {10, 20, 30, 40}


def test_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(5, text), (3, text + " end"), (9, "other words here"), (3, text + " end"), (None, text)]
    docs = spark.createDataFrame([(*x, None, None, 0) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in stages.one_of_each_group(spark, docs, "").collect()) == ["3", "9", "None"]


def test_different_texts_under_one_id(spark, tmp_path):
    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    one, two, item = say(60), say(60), say(40)
    rows = [(1, one), (1, two), (2, two + " end"), (3, None), (3, None), (4, ""), (None, one), (5, say(30) + " " + item), (5, say(50)), (None, item), (6, say(9)), (7, say(70)), (8, None)]
    docs = spark.createDataFrame([(*x, None, "s", 0) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)
    want = sorted([rows[k] for k in range(len(rows)) if k not in (2, 4)], key=str)
    assert left(stages.one_of_each_group(spark, docs, "")) == want
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert left(stages.clean_of_benchmarks(spark, docs, str(tmp_path))) == sorted([x for x in rows if item not in (x[1] or "")], key=str)
    empty = docs.limit(0)
    assert stages.one_of_each_group(spark, empty, "").count() == 0 == stages.clean_of_benchmarks(spark, empty, str(tmp_path)).count()


def test_wrappers_hide_no_article():
    said = ["This paragraph tells a long story with many words in it, and it ends here.", "Another one follows it with quite as many words, and so the text goes on."]
    body = "".join(f"<p>{x}</p>" for x in said)
    rest = "<nav><a href=a>Home</a></nav><div class='cookie-notice'><p>We use cookies to improve this site, so accept all of them now.</p></div><div id='comments'><p>I think that this is a great text, thank you for it.</p></div><footer>Us</footer>"
    for wrapper in ("post-tags-main", "page-header", "content share-enabled", "form-page", "notice", "main-menu-open wrapper", "story-banner-image content"):
        for page in (f"<div class='{wrapper}'>{body}</div>{rest}", f"<div class='{wrapper}'><div><section>{body}</section></div></div>{rest}"):
            assert main_text.main_text(f"<html><body>{page}</body></html>") == "\n".join(said), page
    assert main_text.main_text(f"<div class='comments'>{body}</div>") == main_text.main_text(f"<aside>{body}</aside>") == ""


def test_deep_pages_take_linear_time():
    import time

    for unit in ("<div>x", "<div>", "</b><td>", "<div></p>", "<li>a", "<a ", "<!x", "<table><td>y"):
        start = time.perf_counter()
        main_text.main_text(unit * 50_000)
        assert time.perf_counter() - start < 10, unit


def test_title_and_links_of_odd_markup():
    title, links = main_text.title_and_links(
        """<html><head><title lang=x> A &amp;\n B </title><script>var s = '<a href="no1">';</script></head><body><!-- <a href="no2"> --><a data-href="x" href="y">1</a>
        <a href="it's.html">2</a><a title="a>b" href=z>3</a><A HREF = '  /c?a=1&amp;b=2 '>4</A><a name=n>5</a><title>no</title><a href>6</a><area href="no3"><style><a href=no4></style></body>"""
    )
    assert title == "A & B" and links == ["y", "it's.html", "z", "/c?a=1&b=2", ""]
    assert main_text.title_and_links("") == ("", []) == main_text.title_and_links("<title") and main_text.title_and_links("<title>open") == ("open", [])


def test_odd_markup_takes_linear_time():
    import time

    for unit in ("<a ", "<title>", "<title ", "<!--", "<a href='", "</", "<script>"):
        start = time.perf_counter()
        main_text.title_and_links(unit * 20_000)
        assert time.perf_counter() - start < 3, unit
