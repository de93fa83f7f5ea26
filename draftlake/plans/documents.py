"""Queries on chunks, retrieval, evidence and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import documents as D
from ..operators import rows as R
from ..sources.scratch import written
from .fixtures import duck, frame
from .registry import query

_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?…][”’\"」』]{0,2})', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("split_sentences", duck(f"SELECT doc_id, unnest({_SENTENCES}) AS sentence FROM {{documents}}"))
def split_sentences(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", F.explode(D.sentences(F.col("text"))).alias("sentence"))


@query("split_sentences_long")
def split_sentences_long(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", F.posexplode(D.sentences_long(F.col("text"), 120)).alias("seq", "sentence"))


def _chunks(spark, sf, size, overlap):
    return D.chunk_table(frame(spark, sf, "documents").select("doc_id", "text"), D.chunks(F.col("text"), size, overlap)).select("doc_id", "seq", "chunk_id", "chunk")


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    """Chunks of the shipped size and overlap."""
    return _chunks(spark, sf, 200, 50)


@query("small_to_big")
def small_to_big(spark, sf):
    """Chunks of the default size, cut to smaller ones that know their parent."""
    return D.small_to_big(_chunks(spark, sf, 510, 200), 128)


@query("small_to_big_text", duck("SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM {documents} WHERE regexp_matches(text, '\\S')"))
def small_to_big_text(spark, sf):
    """Each text, blanks aside, put together again from the small chunks by way of their parents."""
    parents = written(_chunks(spark, sf, 510, 0), "parents")
    small = D.small_to_big(parents, 128).join(parents.select(F.col("chunk_id").alias("parent_id"), "doc_id", F.col("seq").alias("big")), "parent_id")
    whole = R.joined_in_order(small, ["doc_id"], "chunk", ["big", "seq"], "")
    return whole.select("doc_id", F.md5(F.regexp_replace("chunk", r"\s+", "")).alias("digest"))


@query("chunk_catalog", duck(f"SELECT doc_id, i - 1 AS seq, md5(concat(doc_id, '|', i - 1)) AS chunk_id, source FROM (SELECT doc_id, source, unnest(range(1, len({_SENTENCES}) + 1)) AS i FROM {{documents}})"))
def chunk_catalog(spark, sf):
    rows = D.chunk_table(frame(spark, sf, "documents"), D.sentences(F.col("text")))
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return rows.withColumn("metadata", meta).select("doc_id", F.col("seq").cast("long").alias("seq"), "chunk_id", F.col("metadata")["source"].alias("source"))


@query("replace_by_source", duck("SELECT doc_id, source FROM {documents} WHERE source NOT IN (SELECT source FROM {documents} WHERE doc_id % 10 = 0 AND source < 'src2') UNION ALL SELECT doc_id + 1000000, source FROM {documents} WHERE doc_id % 10 = 0 AND source < 'src2'"))
def replace_by_source(spark, sf):
    d = frame(spark, sf, "documents").select("doc_id", "source")
    fresh = d.filter("doc_id % 10 = 0 AND source < 'src2'").select((F.col("doc_id") + 1000000).alias("doc_id"), "source")
    return D.replace_by_source(d, fresh)


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * x)))"
_NEAR = f"SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS score FROM {{embeddings}} q JOIN {{embeddings}} c ON q.vec_id % 20 = 0"
_RANKED = f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank, round(score, 9) AS score FROM ({_NEAR})"


def _nearest(spark, sf, k, least=None):
    e = frame(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return D.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k, least)


_LEAST = 0.123456


@query("vector_topk", duck(f"SELECT query_id, id, rank FROM ({_RANKED}) WHERE rank <= 10 AND score >= {_LEAST}"))
def vector_topk(spark, sf):
    """The nearest vectors of each query, none below a score."""
    return _nearest(spark, sf, 10, _LEAST).select("query_id", "id", "rank")


@query("keyword_filter", duck(f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS place FROM ({_RANKED}) JOIN {{documents}} d ON d.doc_id = id WHERE rank <= 20 AND (contains(text, ' of ') OR contains(text, ' la ')) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5"))
def keyword_filter(spark, sf):
    near = _nearest(spark, sf, 20).join(frame(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    hit = near.filter(F.contains("text", F.lit(" of ")) | F.contains("text", F.lit(" la ")))
    return R.best_row(hit, ["query_id"], [F.col("rank")], 5).select("query_id", "id", "place")


_LISTS = "SELECT o_custkey % 20 AS query_id, p_brand AS text, 'a' AS list, 1.0 AS weight, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY sum(o_totalprice) DESC, p_brand) AS INT) AS rank FROM {orders} JOIN {part} ON p_partkey = o_orderkey GROUP BY o_custkey % 20, p_brand UNION ALL SELECT o_custkey % 20, p_brand, 'b', 0.5, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY count(*) DESC, p_brand) AS INT) FROM {orders} JOIN {part} ON p_partkey = o_orderkey GROUP BY o_custkey % 20, p_brand"


@query("rank_fusion", duck(f"SELECT query_id, text, round(sum(weight / (60 + rank)), 9) AS score FROM ({_LISTS}) GROUP BY ALL"))
def rank_fusion(spark, sf):
    lists = spark.sql(_LISTS, orders=frame(spark, sf, "orders"), part=frame(spark, sf, "part")).withColumn("weight", F.col("weight").cast("double"))
    return D.rank_fusion(lists).select("query_id", "text", F.round("score", 9).alias("score"))


#: Each question has its own vector and those of two variants; every third question has no variant and every sixth no word list either.
_VARIANTS = "SELECT vec_id AS query_id, 0 AS variant, vec_id FROM {embeddings} WHERE vec_id % 20 = 0 UNION ALL SELECT q.vec_id, CAST(v.vec_id - q.vec_id AS INT), v.vec_id FROM {embeddings} q JOIN {embeddings} v ON v.vec_id - q.vec_id IN (1, 2) WHERE q.vec_id % 20 = 0 AND q.vec_id % 3 <> 0"
_LISTED = f"""v AS ({_VARIANTS}), n AS (SELECT v.query_id, variant, c.vec_id AS id, round({_COS}, 9) AS score FROM v JOIN {{embeddings}} q ON q.vec_id = v.vec_id JOIN {{embeddings}} c ON true),
    r AS (SELECT query_id, variant, id, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS rank FROM n),
    w AS (SELECT query_id, variant, id, row_number() OVER (PARTITION BY query_id, variant ORDER BY rank) AS rank FROM r JOIN {{documents}} d ON d.doc_id = id WHERE rank <= 20 AND contains(text, ' of ') AND query_id % 6 <> 0),
    l AS (SELECT query_id, variant * 2 AS list, id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, variant * 2 + 1, id, rank FROM w WHERE rank <= 10)"""


@query("retrieve", duck(f"""WITH {_LISTED}, f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM l GROUP BY ALL),
    s AS (SELECT query_id, count(DISTINCT list) AS lists FROM l GROUP BY query_id)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lists > 1 THEN score END DESC, first, id) AS INT) AS place FROM f JOIN s USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lists > 1 THEN score END DESC, first, id) <= 8"""))
def retrieve(spark, sf):
    """Several variants of each question, by vectors and by words, fused."""
    e = frame(spark, sf, "embeddings")
    variants = spark.sql(_VARIANTS, embeddings=e)
    own = F.struct("query_id", "variant")
    q = variants.join(e, "vec_id").select(own.alias("query_id"), F.col("embedding").alias("query_vector"))
    near = written(D.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 20).select("query_id.*", "id", "rank"), "near")
    texts = frame(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    words = near.filter("query_id % 6 <> 0").join(texts, "id").filter(F.contains("text", F.lit(" of ")))
    words = R.best_row(words, ["query_id", "variant"], [F.col("rank")], 10)
    lists = near.filter("rank <= 10").select("query_id", (F.col("variant") * 2).alias("list"), "id", "rank")
    lists = lists.union(words.select("query_id", (F.col("variant") * 2 + 1).alias("list"), "id", F.col("place").alias("rank")))
    return D.retrieve(lists, 8)


@query("rerank_merge", duck("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) AS INT) AS place FROM (SELECT o_custkey, o_orderkey, coalesce(p_retailprice, -1) AS s FROM {orders} LEFT JOIN {part} ON p_partkey = o_orderkey) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) <= 4"))
def rerank_merge(spark, sf):
    scores = frame(spark, sf, "part").select(F.col("p_partkey").alias("o_orderkey"), F.col("p_retailprice").alias("s"))
    rows = frame(spark, sf, "orders").join(scores, "o_orderkey", "left").withColumn("s", F.coalesce("s", F.lit(-1.0)))
    return R.best_row(rows, ["o_custkey"], [F.desc("s"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "place")


@query("context_pack", duck("SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {documents}) WHERE r <= 5 GROUP BY source"))
def context_pack(spark, sf):
    top = R.best_row(frame(spark, sf, "documents"), ["source"], [F.col("doc_id")], 5).withColumn("context", F.col("text"))
    return R.joined_in_order(top, ["source"], "context", ["doc_id"], "\n")


@query("chat_turns", duck("SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn, role, text) AS message FROM {conversations} GROUP BY conv_id"))
def chat_turns(spark, sf):
    c = frame(spark, sf, "conversations").filter("role IS NOT NULL OR text IS NOT NULL").withColumn("message", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))))
    return R.joined_in_order(c, ["conv_id"], "message", ["turn", "role", "text"], "\n")


@query("distinct_by_content", duck("SELECT text, min(doc_id) AS doc_id FROM {documents} GROUP BY text"))
def distinct_by_content(spark, sf):
    return D.distinct_by_content(frame(spark, sf, "documents").select("text", "doc_id"), "text", ["doc_id"])


@query("remove_used", duck("SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})"))
def remove_used(spark, sf):
    return frame(spark, sf, "documents").join(frame(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("scan_titled_paragraphs", duck("SELECT doc_id, source AS title, text AS content FROM {documents} WHERE NOT contains(text, '**') UNION ALL SELECT doc_id, 'end', lang FROM {documents} WHERE NOT contains(text, '**')"))
def scan_titled_paragraphs(spark, sf):
    d = frame(spark, sf, "documents").filter(~F.contains("text", F.lit("**")))
    mark = F.concat(F.lit("**"), "source", F.lit("**\n"), "text", F.lit("\n**end**\n"), "lang")
    return d.select("doc_id", F.inline(D.paragraphs(mark)))


@query("table_to_text", duck("SELECT p_partkey, concat(p_brand, '|', p_type, chr(10), p_size, '|') AS text FROM {part}"))
def table_to_text(spark, sf):
    cells = F.array(F.array("p_brand", "p_type"), F.array(F.col("p_size").cast("string"), F.lit("")))
    return frame(spark, sf, "part").select("p_partkey", D.table_text(cells).alias("text"))


@query("evidence_span_filter", duck("SELECT d.doc_id, d.text AS snippet, l.quality AS target FROM {documents} d JOIN {labels} l USING (doc_id) WHERE l.quality = 1"))
def evidence_span_filter(spark, sf):
    spans = frame(spark, sf, "labels").withColumn("target", F.when(F.col("quality") == 1, F.col("quality").cast("string")).otherwise(" "))
    hit = frame(spark, sf, "documents").join(spans, "doc_id").filter(F.trim("target") != "")
    return hit.select("doc_id", F.col("text").alias("snippet"), F.col("target").cast("int").alias("target"))


@query("rerun_skip", duck("SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL)"))
def rerun_skip(spark, sf):
    return frame(spark, sf, "documents").join(frame(spark, sf, "labels").filter("quality IS NOT NULL"), "doc_id", "left_anti").select("doc_id")


@query("structure_fallback", duck("SELECT n_nationkey, s_suppkey AS file, 'own' AS origin FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey AND s_suppkey % 4 = 0 UNION ALL SELECT n_nationkey, c_custkey, 'design' FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_suppkey % 4 = 0)"))
def structure_fallback(spark, sf):
    n = frame(spark, sf, "nation").select("n_nationkey")
    own = frame(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("file"))
    design = frame(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("file"))
    rest = n.join(own, "n_nationkey", "left_anti").join(design, "n_nationkey").withColumn("origin", F.lit("design"))
    return n.join(own, "n_nationkey").withColumn("origin", F.lit("own")).unionByName(rest)


@query("file_identity", duck("SELECT c_custkey, md5(concat_ws('|', c_name, 'file', c_custkey % 97)) AS identity FROM {customer}"))
def file_identity(spark, sf):
    return frame(spark, sf, "customer").select("c_custkey", C.file_identity(F.col("c_name"), F.lit("file"), F.col("c_custkey") % 97).alias("identity"))


@query("route_by_suffix", duck("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'drawing' WHEN 1 THEN 'document' WHEN 2 THEN 'cost' END AS parser FROM {customer}"))
def route_by_suffix(spark, sf):
    suffix = F.get(F.array(F.lit(".dwg"), F.lit(".docx"), F.lit(".xml"), F.lit(".bin")), (F.col("c_custkey") % 4).cast("int"))
    routes = spark.createDataFrame([(".dwg", "drawing"), (".docx", "document"), (".doc", "document"), (".xml", "cost"), (".png", "image")], "suffix string, parser string")
    return frame(spark, sf, "customer").withColumn("suffix", suffix).join(F.broadcast(routes), "suffix", "left").select("c_custkey", "parser")


@query("parse_points", duck("SELECT ent_id, minx, miny, maxx, maxy FROM {ent}"))
def parse_points(spark, sf):
    text = F.concat_ws(";", F.concat_ws(",", "minx", "miny"), F.concat_ws(",", "maxx", "maxy"))
    pts = F.transform(F.split(text, ";"), lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).cast("long").alias("x"), F.split_part(p, F.lit(","), F.lit(2)).cast("long").alias("y")))
    e = frame(spark, sf, "ent").select("ent_id", pts.alias("p"))
    return e.select("ent_id", F.col("p")[0]["x"].alias("minx"), F.col("p")[0]["y"].alias("miny"), F.col("p")[1]["x"].alias("maxx"), F.col("p")[1]["y"].alias("maxy"))


@query("nested_roundtrip", duck("SELECT ent_id, drawing_id, minx, miny, maxx, maxy FROM {ent}"))
def nested_roundtrip(spark, sf):
    e = frame(spark, sf, "ent")
    packed = F.struct("ent_id", "drawing_id", F.struct("minx", "miny", "maxx", "maxy").alias("bounds"))
    schema = "ent_id bigint, drawing_id bigint, bounds struct<minx:bigint,miny:bigint,maxx:bigint,maxy:bigint>"
    return e.select(F.from_json(F.to_json(packed), schema).alias("r")).select("r.ent_id", "r.drawing_id", "r.bounds.*")


@query("children", duck("SELECT id, name FROM {tree} WHERE parent = 'n7'"))
def children(spark, sf):
    return frame(spark, sf, "tree").filter("parent = 'n7'").select("id", "name")


@query("full_path", duck("WITH RECURSIVE p AS (SELECT id, name AS path, 0 AS depth FROM {tree} WHERE parent IS NULL UNION ALL SELECT t.id, concat(p.path, '/', t.name), p.depth + 1 FROM {tree} t JOIN p ON t.parent = p.id) SELECT * FROM p"))
def full_path(spark, sf):
    return C.full_paths(frame(spark, sf, "tree"))


@query("name_conflicts", duck("SELECT c_nationkey AS folder, substr(c_name, -2) AS name, count(*) AS n FROM {customer} GROUP BY ALL HAVING count(*) > 1"))
def name_conflicts(spark, sf):
    return frame(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("folder"), F.substring("c_name", -2, 2).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("upsert_file_version", duck("SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 5 ELSE c_custkey END AS size, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END ELSE 1 END AS version FROM {customer} WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"))
def upsert_file_version(spark, sf):
    c = frame(spark, sf, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("size"), F.lit(2).alias("version"))
    new = c.filter("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), (F.col("c_custkey") + 5).alias("size"))
    return C.upsert_versions(old, new)


@query("docs_by_metadata", duck("SELECT doc_id FROM {documents} WHERE source = 'src3' AND lang = 'en'"))
def docs_by_metadata(spark, sf):
    d = frame(spark, sf, "documents").withColumn("metadata", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")))
    return d.filter((F.col("metadata")["source"] == "src3") & (F.col("metadata")["lang"] == "en")).select("doc_id")


@query("bases_with_files", duck("SELECT source, count(*) AS file_count FROM {documents} GROUP BY source HAVING count(*) > 40"))
def bases_with_files(spark, sf):
    return frame(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("file_count")).filter("file_count > 40")


@query("catalog_counts", duck("SELECT source, lang, count(*) AS docs_count, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM {documents} GROUP BY ALL"))
def catalog_counts(spark, sf):
    return frame(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs_count"), F.sum("n_chars").alias("n_chars"))


@query("tree_from_paths", duck("WITH p AS (SELECT DISTINCT concat('d', c_nationkey) AS a, concat('d', c_nationkey, '/', c_name) AS b, c_name AS n FROM {customer}) SELECT md5(b) AS id, md5(a) AS parent, n AS name, 'F' AS kind FROM p UNION SELECT md5(a), NULL, a, 'D' FROM p"))
def tree_from_paths(spark, sf):
    return C.tree_from_paths(frame(spark, sf, "customer").select(F.concat(F.lit("d"), "c_nationkey", F.lit("/"), "c_name").alias("path")))


@query("point_lookup", duck("SELECT id, name, kind, size FROM {tree} WHERE id = 'c42'"))
def point_lookup(spark, sf):
    return frame(spark, sf, "tree").filter("id = 'c42'").select("id", "name", "kind", "size")


@query("path_alias", duck("SELECT c_custkey, n_name AS project FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"))
def path_alias(spark, sf):
    aliases = frame(spark, sf, "nation").select(F.col("n_name").alias("project"), F.explode(F.array(F.concat(F.lit("a"), "n_nationkey"), F.concat(F.lit("b"), "n_nationkey"))).alias("alias"))
    c = frame(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"), "c_nationkey").alias("alias"))
    return c.join(aliases, "alias").select("c_custkey", "project")


@query("field_dependency_join", duck("SELECT o_custkey, max(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END) - max(CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END) AS landscape FROM {orders} GROUP BY o_custkey"))
def field_dependency_join(spark, sf):
    v = frame(spark, sf, "orders").filter("o_orderkey % 3 < 2").withColumn("field", F.when(F.col("o_orderkey") % 3 == 0, "land").otherwise("base"))
    wide = v.groupBy("o_custkey").pivot("field", ["land", "base"]).agg(F.max("o_totalprice"))
    return frame(spark, sf, "orders").select("o_custkey").distinct().join(wide, "o_custkey", "left").select("o_custkey", (F.col("land") - F.col("base")).alias("landscape"))


@query("route_to_file", duck("WITH h AS (SELECT c_custkey, n_nationkey FROM {customer} JOIN {nation} ON contains(concat(c_name, ' ', c_custkey % 30), concat(' ', n_nationkey))) SELECT c_custkey, min(n_nationkey) AS file FROM h GROUP BY c_custkey HAVING count(*) = 1"))
def route_to_file(spark, sf):
    """The one file whose keyword a question holds; the keyword list is the fixed table of files."""
    keys = frame(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("key"))
    q = frame(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), (F.col("c_custkey") % 30).cast("string")).alias("question"))
    hit = q.join(F.broadcast(keys), F.contains("question", "key"))
    return hit.groupBy("c_custkey").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("c_custkey", "file")
