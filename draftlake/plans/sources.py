"""Queries on files, stores and streams: each writes what it reads to a new folder that all executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import files as P
from ..sources import labels as L
from ..sources import stores as S
from ..sources.scratch import new_path
from ..streaming import tasks
from .fixtures import duck, frame
from .registry import query

_FOLDER = "CASE p_size % 6 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(P.FOLDERS)) + " END"
_SCOPE = "CASE p_size % 6 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(P.FOLDERS.values())) + " END"
_KIND, _DISCIPLINE = "CASE WHEN p_partkey % 2 = 0 THEN '住宅' ELSE '地下室' END", "CASE p_partkey % 3 WHEN 0 THEN '建筑' WHEN 1 THEN '结构' ELSE '立面' END"
_PROJECT = "concat('p', p_partkey % 4)"


def _folders(spark, sf):
    """Project folders with an XML file in each, and files of other suffixes beside them."""
    root = new_path(spark, "projects")
    part = frame(spark, sf, "part").selectExpr(f"{_PROJECT} AS project", f"{_FOLDER} AS folder", f"{_KIND} AS kind", f"{_DISCIPLINE} AS discipline", "p_partkey AS _id", "p_size AS _size", "named_struct('_brand', p_brand) AS sub")
    for rows, folders in ((part.filter("folder <> '业态'").drop("kind", "discipline"), ["project", "folder"]), (part.filter("folder = '业态'"), ["project", "folder", "kind", "discipline"])):
        dealt = rows.repartition(*folders)
        dealt.write.mode("append").partitionBy(*folders).option("rootTag", "cost").option("rowTag", "item").format("xml").save(root)
        dealt.select(*folders, F.col("_id").alias("id")).write.mode("append").partitionBy(*folders).json(root)
    return root


_TREE = f"SELECT DISTINCT {_PROJECT} AS project, {_SCOPE} AS scope, CASE WHEN p_size % 6 = 5 THEN {_KIND} END AS building_type, CASE WHEN p_size % 6 = 5 THEN {_DISCIPLINE} END AS discipline, '.xml' AS suffix FROM {{part}}"


@query("scan_project_tree", duck(_TREE))
def scan_project_tree(spark, sf):
    """Files of project folders with an allowed suffix; the folders that a project must have are all there."""
    found = P.project_files(spark, _folders(spark, sf), required=("TENDER", "BUSINESS"))
    return found.select("project", "scope", "building_type", "discipline", "suffix")


@query("file_arrival_stream", duck(_TREE))
def file_arrival_stream(spark, sf):
    """The same files as a stream meets them, written by its batches."""
    root, out = _folders(spark, sf), new_path(spark, "arrived")
    stream = P.arriving_files(spark, root, per_batch=40).select("project", "scope", "building_type", "discipline", "suffix")
    stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "arrivals")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("scan_xml_attributes", duck(f"SELECT {_PROJECT} AS project, line, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, unnest([concat(p_partkey, '|', p_size), p_brand]) AS line FROM {{part}}) GROUP BY ALL UNION ALL SELECT project, '', count(*) FROM ({_TREE}) GROUP BY project"))
def scan_xml_attributes(spark, sf):
    """The attribute lines of all elements of all XML files; the root of each file has none."""
    root = _folders(spark, sf)
    lines = P.xml_attributes(spark, root).join(P.project_files(spark, root).select("path", "project"), "path")
    return lines.groupBy("project", "line").agg(F.count(F.lit(1)).alias("n"))


@query("convert_label_rows", duck("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(replace(replace(replace(source, chr(9), ' '), chr(10), ' '), '|', ' '), '') AS instruction, [doc_id % 7, doc_id % 11] AS s, [doc_id % 7 + 3, doc_id % 11 + 5] AS e, coalesce(lang, '') AS target FROM {documents} ORDER BY id LIMIT 500"))
def convert_label_rows(spark, sf):
    """Span rows from lines with tabs to JSON, the first 500 by id, and on to lines with a separator of several characters."""
    tsv, as_json, flat = (new_path(spark, n) for n in ("tsv", "json", "flat"))
    d = frame(spark, sf, "documents").select("doc_id", F.translate(F.coalesce("source", F.lit("")), "\t\n|", "   ").alias("instruction"), F.coalesce("lang", F.lit("")).alias("target"))
    k = F.col("doc_id")
    line = F.concat_ws("\t", k.cast("string"), F.concat(F.lit('["'), "instruction", F.lit('"]')), F.to_json(F.array(k % 7, k % 11)), F.to_json(F.array(k % 7 + 3, k % 11 + 5)), "target")
    d.select(line).write.text(tsv)
    L.write_json(L.read_tsv(spark, tsv), as_json, 500)
    L.write_delimited(L.read_json(spark, as_json), flat)
    return L.read_delimited(spark, flat).select("id", "instruction", F.col("start").cast("array<bigint>").alias("s"), F.col("end").cast("array<bigint>").alias("e"), "target")


#: The five result sets of a parsed file.
RESULT_SETS = {"contents": "seq int, text string", "paragraphs": "title string, content string", "facades": "level double", "texts": "text string", "tables": "seq int, text string"}


def _parse(run: str):
    def parse(files):
        lines = files.select("identity", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
        return {
            "contents": lines, "tables": lines.filter(F.contains("text", F.lit(","))), "texts": files.select("identity", F.lit(run).alias("text")),
            "paragraphs": files.select("identity", F.lit("").alias("title"), F.lit("").alias("content")).limit(0), "facades": files.select("identity", F.lit(0.0).alias("level")).limit(0),
        }

    return parse


@query("incremental_parse", duck("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'first' ELSE 'second' END AS run, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_contents,
    CAST(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, ','))) AS BIGINT) AS n_tables FROM {documents}"""))
def incremental_parse(spark, sf):
    """Three runs: a third of the files; all, of which every fifth has changed; all again.  Each file is parsed by the run that met it first in its present form."""
    d = frame(spark, sf, "documents").select("doc_id", "text", "n_chars")
    identity = lambda size: C.file_identity(F.concat(F.lit("d/"), F.col("doc_id").cast("string")), F.lit("text"), size)
    before = d.withColumn("identity", identity(F.col("n_chars")))
    now = d.withColumn("identity", identity(F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)))
    store = S.ParsedFiles(spark, new_path(spark, "parsed"), RESULT_SETS)
    store.add("1", before.filter("doc_id % 3 = 0"), _parse("first"))
    store.add("2", now, _parse("second"))
    store.add("3", now, _parse("third"))
    count = lambda name, n: store.load(name, now).groupBy("identity").agg(F.count(F.lit(1)).alias(n))
    found = now.join(store.load("texts", now).select("identity", F.col("text").alias("run")), "identity").join(count("contents", "n_contents"), "identity").join(count("tables", "n_tables"), "identity", "left")
    return found.select("doc_id", "run", "n_contents", F.coalesce("n_tables", F.lit(0)).alias("n_tables"))


_TYPES = ("AcDbLine", "AcDbText", "AcDbCircle", "AcDbMText", "AcDbArc")


@query("scan_entities", duck("SELECT CASE ent_id % 5 WHEN 1 THEN 'AcDbText' ELSE 'AcDbMText' END AS type_name, ent_id, drawing_id, minx, maxy FROM {ent} WHERE ent_id % 5 IN (1, 3) AND drawing_id BETWEEN 10 AND 79"))
def scan_entities(spark, sf):
    """Two types of entities of a range of drawings from a table with a folder for each type."""
    folder = new_path(spark, "entities")
    S.write_entities(frame(spark, sf, "ent").withColumn("type_id", (F.col("ent_id") % 5).cast("int")), folder)
    types = spark.createDataFrame(list(enumerate(_TYPES)), "type_id int, type_name string")
    return S.scan_entities(spark, folder, types, ["AcDbText", "AcDbMText"], ["ent_id", "drawing_id", "minx", "maxy"], (10, 79))


@query("index_update_stream", duck("SELECT doc_id, source FROM {documents} WHERE source NOT IN (SELECT source FROM {documents} WHERE doc_id % 10 = 0 AND source < 'src2') UNION ALL SELECT doc_id + 1000000, source FROM {documents} WHERE doc_id % 10 = 0 AND source < 'src2'"))
def index_update_stream(spark, sf):
    """An index kept by a stream of two batches: all chunks, then new ones of some sources."""
    d, path = frame(spark, sf, "documents").filter("source IS NOT NULL").select("doc_id", "source"), new_path(spark, "chunks")
    d.coalesce(1).write.parquet(path)
    d.filter("doc_id % 10 = 0 AND source < 'src2'").select((F.col("doc_id") + 1000000).alias("doc_id"), "source").coalesce(1).write.mode("append").parquet(path)
    index = S.ChunkIndex(spark, new_path(spark, "index"), "doc_id bigint, source string")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    tasks.keep_index(stream, index).option("checkpointLocation", new_path(spark, "updates")).trigger(availableNow=True).start().awaitTermination()
    return index.read()


@query("descendants", duck("WITH RECURSIVE p AS (SELECT id, kind, 1 AS depth FROM {tree} WHERE parent = 'r2' UNION ALL SELECT t.id, t.kind, p.depth + 1 FROM {tree} t JOIN p ON t.parent = p.id) SELECT * FROM p"))
def descendants(spark, sf):
    """All nodes below a folder."""
    t = frame(spark, sf, "tree")
    return C.descendants(t, t.filter("id = 'r2'").select("id")).join(t.select("id", "kind"), "id").select("id", "kind", "depth")
