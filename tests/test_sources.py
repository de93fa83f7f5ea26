"""Files, stores and formats on real folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from draftlake.operators import catalog as C
from draftlake.sources import files as P
from draftlake.sources import labels as L
from draftlake.sources import stores as S
from draftlake.sources.scratch import Folder


def put(root, path, text="x"):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)


def tree(tmp_path):
    for path in ("p1/招标文件/a.docx", "p1/招标文件/deep/er/b.DOCX", "p1/业态/住宅/建筑/c 1.dwg", "p1/业态/住宅/d.png", "p1/业态/住宅/其他/e.xml", "p1/人防/f.txt", "p1/note.doc", "p2/招标文件/a=b.docx", "p2/人防/50%.xml"):
        put(tmp_path, path, path)
    return f"file://{tmp_path}"


def test_project_files(spark, tmp_path):
    root = tree(tmp_path)
    rows = {r["name"]: r for r in P.project_files(spark, root).collect()}
    assert set(rows) == {"a.docx", "b.DOCX", "c 1.dwg", "d.png", "e.xml", "note.doc", "a=b.docx", "50%.xml"}
    of = lambda n: tuple(rows[n][c] for c in ("project", "scope", "building_type", "discipline", "suffix"))
    assert of("b.DOCX") == ("p1", "TENDER", None, None, ".docx") and of("c 1.dwg") == ("p1", "BUSINESS", "住宅", "建筑", ".dwg")
    assert of("d.png") == ("p1", "BUSINESS", "住宅", None, ".png") and of("e.xml")[3] is None and of("note.doc") == ("p1", None, None, None, ".doc")
    assert of("50%.xml") == ("p2", "DEFENSE", None, None, ".xml") and rows["a.docx"]["size"] == len("p1/招标文件/a.docx".encode())
    assert len({r["identity"] for r in rows.values()}) == 8


def test_scanning_reads_no_contents(spark, tmp_path):
    plan = P.project_files(spark, tree(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_missing_scope_is_an_error(spark, tmp_path):
    root = tree(tmp_path)
    assert P.project_files(spark, root, required=("TENDER",)).count() == 8
    with pytest.raises(P.MissingScope, match="p2 has no BUSINESS"):
        P.project_files(spark, root, required=("TENDER", "BUSINESS"))


def test_arriving_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = tree(tmp_path / "in")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = P.arriving_files(spark, root).select("name", "identity")
        stream.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(out).collect())

    assert len(run()) == 8
    put(tmp_path / "in", "p2/招标文件/new.dwg")
    assert len(run()) == 9 and "new.dwg" in run()


def test_xml_attributes(spark, tmp_path):
    put(tmp_path, "p/计价文件/a.xml", '<a x="1" y="二"><b/><b z="&lt;3|"><c q=""/></b></a>')
    put(tmp_path, "p/计价文件/long.xml", "<r>" + "".join(f'<i n="{k}"/>' for k in range(20_000)) + "</r>")
    rows = {}
    for r in P.xml_attributes(spark, f"file://{tmp_path}").orderBy("seq").collect():
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["line"])
    assert rows["a.xml"] == ["1|二", "", "<3|", ""] and rows["long.xml"] == [""] + [str(k) for k in range(20_000)]
    put(tmp_path, "p/计价文件/bad.xml", "<a><b></a>")
    with pytest.raises(Exception, match="bad.xml is not well formed"):
        P.xml_attributes(spark, f"file://{tmp_path}").count()


def test_small_files_come_in_one_step(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/store")
    assert folder.names() == []
    assert folder.put("one", "é\n2") and not folder.put("one", "other") and folder.text("one") == "é\n2"
    assert folder.names() == ["one"]


SETS = {"contents": "seq int, text string", "tables": "text string"}


def parsed(seen, broken=False):
    def parse(files):
        seen.append(sorted(r["name"] for r in files.collect()))
        lines = files.select("identity", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
        return {"contents": lines, "tables": files.select("identity", F.raise_error("killed").cast("string").alias("text") if broken else F.col("text"))}

    return parse


def file_rows(spark, **texts):
    rows = [(n, t) for n, t in texts.items()]
    df = spark.createDataFrame(rows, "name string, text string")
    return df.withColumn("identity", C.file_identity(F.lit("p"), F.col("name"), F.length("text")))


def test_parsed_files(spark, tmp_path):
    store, seen = S.ParsedFiles(spark, f"file://{tmp_path}/parsed", SETS), []
    first = file_rows(spark, a="1\n2", b="3")
    assert store.add("r1", first, parsed(seen)) and seen == [["a", "b"]]
    assert store.add("r2", first, parsed(seen)) and seen[1] == []  # nothing is pending
    assert not store.add("r1", first, parsed(seen)) and len(seen) == 2  # a replay changes nothing
    changed = file_rows(spark, a="1\n2", b="three", c="4")
    with pytest.raises(Exception, match="killed"):
        store.add("r3", changed, parsed(seen, broken=True))
    assert store.load("contents", changed).count() == 2  # the half batch shows nothing
    assert store.add("r3", changed, parsed(seen)) and seen[-1] == ["b", "c"]  # a changed file only itself
    got = sorted((r["seq"], r["text"]) for r in store.load("contents", changed).collect())
    assert got == [(0, "1"), (0, "4"), (0, "three"), (1, "2")]
    assert sorted(r["text"] for r in store.load("tables", first).collect()) == ["1\n2", "3"]


def test_index_of_chunks(spark, tmp_path):
    at = tmp_path / "index"
    index = S.ChunkIndex(spark, f"file://{at}", "source string, chunk string", buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "source string, chunk string")
    everything = lambda: sorted(map(tuple, index.read().collect()))
    assert everything() == []
    assert index.replace(0, rows(*((f"s{k}", f"old{k}") for k in range(20)), ("s1", "more")))
    placed = json.loads((at / "commits" / "000000000000").read_text())["at"]
    assert index.replace(5, rows(("s1", "new"), ("t", "x")))  # batch numbers may have gaps
    after = json.loads((at / "commits" / "000000000005").read_text())["at"]
    assert len([b for b in placed if placed[b] != after[b]]) <= 2 and len([b for b in placed if placed[b] == after[b]]) >= 5  # untouched buckets keep their files
    want = sorted([(f"s{k}", f"old{k}") for k in range(20) if k != 1] + [("s1", "new"), ("t", "x")])
    assert everything() == want
    assert not index.replace(5, rows(("s1", "again"))) and not index.replace(3, rows(("s2", "late"))) and everything() == want
    assert index.replace(6, rows()) and everything() == want


def test_entity_scan_is_pruned(spark, tmp_path):
    folder = f"file://{tmp_path}/entities"
    rows = spark.range(2000).select((F.col("id") % 5).cast("int").alias("type_id"), (F.col("id") % 97).alias("drawing_id"), F.col("id").alias("ent_id"), F.col("id").alias("minx"), F.lit("long text").alias("text"))
    S.write_entities(rows, folder, 2)
    types = spark.createDataFrame([(0, "line"), (1, "text"), (2, "arc"), (3, "mtext")], "type_id int, type_name string")
    found = S.scan_entities(spark, folder, types, ["text", "mtext"], ["ent_id", "minx"], (10, 20))
    assert {r["ent_id"] for r in found.collect()} == {k for k in range(2000) if k % 5 in (1, 3) and 10 <= k % 97 <= 20}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PushedFilters: [IsNotNull(drawing_id), GreaterThanOrEqual(drawing_id,10), LessThanOrEqual(drawing_id,20)]" in plan
    assert "ReadSchema: struct<drawing_id:bigint,ent_id:bigint,minx:bigint>" in plan
    assert S.scan_entities(spark, folder, types, ["none"], ["ent_id"]).count() == 0


def test_label_formats(spark, tmp_path):
    rows = [("1", "问 题", [1, 4], [3, 9], "答"), ("2", "", [], [], ""), ("3", 'a "b" c', [0], [1], "x")]
    put(tmp_path, "in/rows.tsv", "".join(f'{i}\t["{q}"]\t{s}\t{e}\t{t}\n' for i, q, s, e, t in rows))
    tsv = L.read_tsv(spark, f"{tmp_path}/in")
    assert sorted(map(tuple, tsv.collect())) == rows
    L.write_json(tsv, f"{tmp_path}/json", 2)
    assert sorted(map(tuple, L.read_json(spark, f"{tmp_path}/json").collect())) == rows[:2]
    assert "问 题" in "".join(open(f"{tmp_path}/json/{n}").read() for n in os.listdir(f"{tmp_path}/json") if n.startswith("part"))
    L.write_delimited(tsv, f"{tmp_path}/flat")
    assert sorted(map(tuple, L.read_delimited(spark, f"{tmp_path}/flat").collect())) == rows
    bad = spark.createDataFrame([("1", "a|&&|b", [1], [2], "x")], L.SCHEMA)
    with pytest.raises(Exception, match="separator"):
        L.write_delimited(bad, f"{tmp_path}/bad")
    put(tmp_path, "bad.tsv", "1\tonly two")
    with pytest.raises(Exception, match="five fields"):
        L.read_tsv(spark, f"{tmp_path}/bad.tsv").collect()


def test_descendants(spark):
    rows = [("r1", None, "same"), ("r2", None, "same"), ("a", "r1", "x"), ("b", "r2", "x"), ("c", "b", "y"), ("d", "c", "z"), ("d", "b", "z"), ("u", "v", "loop"), ("v", "u", "loop")]
    t = spark.createDataFrame(rows, "id string, parent string, name string")
    below = lambda *roots: sorted(map(tuple, C.descendants(t, t.filter(F.col("id").isin(*roots)).select("id")).collect()))
    assert below("r2") == [("b", 1), ("c", 2), ("d", 2)] and below("r1") == [("a", 1)] and below("d") == []
    assert below("u") == [("u", 2), ("v", 1)] and below("r1", "b") == [("a", 1), ("c", 1), ("d", 1)]


def test_a_cluster_needs_a_shared_folder():
    from draftlake.sources import scratch

    class Session:
        def __init__(self, **settings):
            self.conf, self.settings = self, settings

        def get(self, name, default=None):
            return self.settings.get(name, default)

        def set(self, name, value):
            self.settings[name] = value

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.new_path(Session(**{"spark.master": "spark://host:7077"}), "x")
    with pytest.raises(ValueError):
        scratch.new_path(Session(**{"spark.master": "local-cluster[3,2,1000]"}), "x")
    for master in ("local[8]", "local"):
        assert scratch.new_path(Session(**{"spark.master": master}), "x").startswith("file:///")
    assert scratch.new_path(Session(**{"spark.checkpoint.dir": "s3a://b/c/"}), "x").startswith("s3a://b/c/x-")
