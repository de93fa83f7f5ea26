"""Queries on aggregates, order and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import layout
from ..operators import rows as R
from .fixtures import duck, frame
from .registry import query

_WORDS = ["que", "the", "und", "los"]
_VOTE = ", ".join(f"(CAST(sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)}) AS BIGINT), {-i}, '{w}')" for i, w in enumerate(_WORDS))


@query("category_vote", duck("WITH c AS (" + " UNION ALL ".join(f"SELECT source, CAST(sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)}) AS BIGINT) AS votes, {i} AS place, '{w}' AS category FROM {{documents}} GROUP BY source" for i, w in enumerate(_WORDS)) + ") SELECT source, category, votes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, place) AS r FROM c) WHERE r = 1 AND votes > 0"))
def category_vote(spark, sf):
    return R.category_vote(frame(spark, sf, "documents"), "source", _WORDS)


@query("mode_value", duck("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ts, event_id) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS ts, min_by(event_id, (ts, event_id)) AS event_id FROM {events} GROUP BY ALL)) WHERE r = 1"))
def mode_value(spark, sf):
    return R.mode_value(frame(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("majority_level", duck("SELECT user_id, event_type FROM (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ts, event_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM {events})) WHERE r = 1"))
def majority_level(spark, sf):
    return R.leading_value(frame(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


_MARK = "SELECT drawing_id, ent_id AS id, CAST(text AS DOUBLE) * CASE WHEN ent_id % 3 = 0 THEN -1 ELSE 1 END AS level FROM {number}"


def _marks(spark, sf):
    return frame(spark, sf, "number").selectExpr("drawing_id", "ent_id AS id", "CAST(text AS DOUBLE) * CASE WHEN ent_id % 3 = 0 THEN -1 ELSE 1 END AS level")


@query("building_height", duck(f"SELECT drawing_id, CASE WHEN drawing_id % 4 = 0 THEN abs(min(level)) ELSE max(level) END AS height FROM ({_MARK}) GROUP BY drawing_id"))
def building_height(spark, sf):
    return R.heights(_marks(spark, sf), "drawing_id", F.col("drawing_id") % 4 == 0)


_DIFF = f"SELECT drawing_id, id, round_even(level - lead(level) OVER (PARTITION BY drawing_id ORDER BY level DESC, id), 2) + 0.0 AS difference FROM ({_MARK})"


@query("level_differences", duck(f"SELECT * FROM ({_DIFF}) WHERE difference IS NOT NULL"))
def level_differences(spark, sf):
    return R.level_differences(_marks(spark, sf), ["drawing_id"]).select("drawing_id", "id", "difference")


@query("standard_storey", duck(f"SELECT drawing_id, difference, n FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, id) AS r FROM (SELECT drawing_id, difference, count(*) AS n, min(id) AS id FROM ({_DIFF}) WHERE difference <> 0 GROUP BY ALL)) WHERE r = 1"))
def standard_storey(spark, sf):
    return R.mode_value(R.level_differences(_marks(spark, sf), ["drawing_id"]).filter("difference <> 0"), "drawing_id", "difference", ["id"])


@query("fill_missing_floors", duck("""WITH g AS (SELECT *, lead(floor) OVER (PARTITION BY building ORDER BY floor) AS up FROM {floor_area})
    SELECT building, floor, area, false AS filled FROM g UNION ALL SELECT building, unnest(range(floor + 1, up)) AS floor, area, true FROM g WHERE up > floor + 1"""))
def fill_missing_floors(spark, sf):
    return R.fill_missing_floors(frame(spark, sf, "floor_area"), "building")


@query("floor_area_total", duck("SELECT building, round(sum(CASE WHEN (building % 5 = 0) = (floor % 9 = 0) THEN area ELSE 0 END), 2) AS total FROM {floor_area} GROUP BY building"))
def floor_area_total(spark, sf):
    """Every ninth floor is below ground; every fifth building is a basement."""
    f = frame(spark, sf, "floor_area").withColumn("key", F.concat(F.when(F.col("floor") % 9 == 0, "地下").otherwise(""), F.col("floor").cast("string")))
    below, basement = F.col("key").rlike("负|-|地下"), F.col("building") % 5 == 0
    return f.groupBy("building").agg(F.round(F.sum(F.when(below == basement, F.col("area")).otherwise(0.0)), 2).alias("total"))


@query("floor_count", duck("SELECT building, count(*) FILTER (WHERE area > 0 AND floor % 9 <> 0 AND floor % 11 <> 0) AS floors FROM {floor_area} GROUP BY building"))
def floor_count(spark, sf):
    f = frame(spark, sf, "floor_area").withColumn("key", F.concat(F.when(F.col("floor") % 9 == 0, "地下").otherwise(""), F.col("floor").cast("string"), F.when(F.col("floor") % 11 == 0, "层夹层").otherwise("层")))
    good = (F.col("area") > 0) & F.col("key").rlike("^[0-9首一二三四五六七八九十]") & ~F.contains("key", F.lit("夹"))
    return f.groupBy("building").agg(F.count_if(good).alias("floors"))


@query("above_below_area", duck("SELECT sum(CASE WHEN building % 5 = 0 THEN area ELSE 0 END) AS below, sum(CASE WHEN building % 5 <> 0 THEN area ELSE 0 END) AS above FROM {floor_area}"))
def above_below_area(spark, sf):
    f = frame(spark, sf, "floor_area").withColumn("name", F.when(F.col("building") % 5 == 0, "地下室").otherwise("住宅"))
    under = F.contains("name", F.lit("地下"))
    return f.agg(F.sum(F.when(under, F.col("area")).otherwise(0.0)).alias("below"), F.sum(F.when(~under, F.col("area")).otherwise(0.0)).alias("above"))


@query("group_blocks_by_level", duck("SELECT building, floor, string_agg(p_name, '|' ORDER BY p_partkey) AS blocks FROM (SELECT p_partkey % 50 AS building, p_size AS floor, p_partkey, p_name, bool_or(p_partkey % 17 = 0) OVER (PARTITION BY p_partkey % 50, p_size ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM {part}) WHERE NOT coalesce(done, false) GROUP BY ALL"))
def group_blocks_by_level(spark, sf):
    """A roof block (every seventeenth) ends its level."""
    p = frame(spark, sf, "part").select((F.col("p_partkey") % 50).alias("building"), F.col("p_size").alias("floor"), "p_partkey", F.col("p_name").alias("blocks"))
    before = Window.partitionBy("building", "floor").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("p_partkey") % 17 == 0)).over(before), F.lit(False))
    return R.joined_in_order(p.withColumn("done", done).filter("NOT done"), ["building", "floor"], "blocks", ["p_partkey"], "|")


_TEXTS = "SELECT drawing_id, ent_id, minx, miny, maxx, maxy, CAST(ent_id AS VARCHAR) AS text FROM {ent}"
_LINES = f"SELECT *, sum(new) OVER (PARTITION BY drawing_id ORDER BY miny DESC, minx, ent_id) AS line FROM (SELECT *, CASE WHEN lag(miny) OVER (PARTITION BY drawing_id ORDER BY miny DESC, minx, ent_id) - miny > 40 THEN 1 ELSE 0 END AS new FROM ({_TEXTS}))"
_PLACES = f"SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY line, minx, miny DESC, ent_id) AS place FROM ({_LINES})"


def _texts(spark, sf):
    return frame(spark, sf, "ent").withColumn("text", F.col("ent_id").cast("string"))


@query("reading_order", duck(f"SELECT drawing_id, ent_id, CAST(line AS BIGINT) AS line, CAST(place AS INT) AS place FROM ({_PLACES})"))
def reading_order(spark, sf):
    return R.reading_order(_texts(spark, sf), "drawing_id", 40).select("drawing_id", "ent_id", "line", "place")


@query("block_text", duck(f"SELECT drawing_id, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT drawing_id, line, string_agg(text, '' ORDER BY place) AS t FROM ({_PLACES}) GROUP BY ALL) GROUP BY drawing_id"))
def block_text(spark, sf):
    return R.block_text(R.reading_order(_texts(spark, sf), "drawing_id", 40), "drawing_id")


@query("merge_tilde_runs", duck("SELECT ent_id AS row_id, CAST(minx AS BIGINT) AS minx, text FROM (SELECT ent_id, 0 AS minx, concat('a', ent_id, '~b', ent_id) AS text FROM {ent} UNION ALL SELECT ent_id, 40, 'c' FROM {ent})"))
def merge_tilde_runs(spark, sf):
    e = frame(spark, sf, "ent")
    parts = F.array(F.struct(F.lit(0).cast("long").alias("minx"), F.concat(F.lit("a"), "ent_id").alias("text")), F.struct(F.lit(10).cast("long").alias("minx"), F.lit("~").alias("text")), F.struct(F.lit(20).cast("long").alias("minx"), F.concat(F.lit("b"), "ent_id").alias("text")), F.struct(F.lit(40).cast("long").alias("minx"), F.lit("c").alias("text")))
    t = e.select(F.col("ent_id").alias("row_id"), "ent_id", F.inline(parts))
    return R.merge_tilde_runs(t, ["row_id"]).select("row_id", "minx", "text")


@query("row_mates", duck("SELECT k.ent_id AS key_id, string_agg(m.text, ' ' ORDER BY m.minx, m.ent_id) AS text FROM {txt} k JOIN {txt} m ON k.drawing_id = m.drawing_id AND (m.miny + m.maxy) / 2 BETWEEN k.miny AND k.maxy GROUP BY k.ent_id"))
def row_mates(spark, sf):
    """Texts whose centre lies in the key text's band, from left to right, put together inside the cells of the bands."""
    t = frame(spark, sf, "txt")
    k = t.select("drawing_id", F.col("ent_id").alias("key_id"), F.col("miny").alias("low"), F.col("maxy").alias("high"))
    m = t.select("drawing_id", "ent_id", "minx", ((F.col("miny") + F.col("maxy")) / 2).alias("at"), "text")
    bands = frame(spark, sf, "ent").select(F.col("miny").alias("low"), F.col("maxy").alias("high"))
    return C.gathered(k, m, ["key_id"], ["minx", "ent_id"], mark=" ", bands=bands)


@query("table_below_title", duck("SELECT t.ent_id AS title_id, max_by(b.ent_id, (b.maxy, -b.ent_id)) AS table_id FROM {txt} t JOIN {ent} b ON t.drawing_id = b.drawing_id AND b.minx BETWEEN t.minx - 1000 AND t.maxx AND b.maxy < t.miny GROUP BY t.ent_id"))
def table_below_title(spark, sf):
    t = frame(spark, sf, "txt").select("drawing_id", F.col("ent_id").alias("id"), (F.col("minx") - 1000).alias("x1"), F.col("maxx").alias("x2"), F.col("miny").alias("y"))
    return layout.topmost_below(t, frame(spark, sf, "ent")).select(F.col("id").alias("title_id"), F.col("ent_id").alias("table_id"))


@query("value_right_of", duck("SELECT k.ent_id AS key_id, min_by(v.ent_id, (v.minx, v.ent_id)) AS value_id FROM {txt} k JOIN {txt} v ON k.drawing_id = v.drawing_id AND v.minx > k.maxx AND v.miny >= k.miny AND v.maxy <= k.maxy WHERE trim(v.text) NOT IN (':', '：') GROUP BY k.ent_id"))
def value_right_of(spark, sf):
    t = frame(spark, sf, "txt")
    return layout.right_of(t, t)


@query("top_k", duck("SELECT o_custkey, o_orderkey, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r <= 3"))
def top_k(spark, sf):
    return R.best_row(frame(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("first_match", duck("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey"))
def first_match(spark, sf):
    return frame(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("task_order", duck("SELECT task_id, CAST(row_number() OVER (ORDER BY max(ts) DESC, task_id) AS INT) AS place FROM {task_log} GROUP BY task_id"))
def task_order(spark, sf):
    last = frame(spark, sf, "task_log").groupBy("task_id").agg(F.max("ts").alias("ts"))
    return R.newest_first(last, "ts", "task_id").select("task_id", F.col("place").cast("int").alias("place"))


@query("task_state_stream", duck("SELECT task_id, max_by(CASE kind WHEN 'FINISH' THEN 'SUCCESS' WHEN 'FAIL' THEN 'FAILURE' ELSE 'RUNNING' END, ts) AS status, max(CASE WHEN kind = 'PROGRESS' THEN value END) AS progress, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_messages FROM {task_log} GROUP BY task_id"))
def task_state_stream(spark, sf):
    """The batch twin of the stream in draftlake.streaming.tasks."""
    return R.task_states(frame(spark, sf, "task_log"))


@query("task_actions", duck("""WITH s AS (SELECT task_id, CASE max_by(kind, ts) WHEN 'FINISH' THEN 'SUCCESS' WHEN 'FAIL' THEN 'FAILURE' WHEN 'START' THEN 'PENDING' ELSE 'RUNNING' END AS status FROM {task_log} GROUP BY task_id)
    SELECT task_id, status, status = 'PENDING' AND (SELECT count(*) FROM s WHERE status = 'RUNNING') = 0 AS may_start, status = 'RUNNING' AS may_stop, status <> 'RUNNING' AS may_delete FROM s"""))
def task_actions(spark, sf):
    status = F.when(F.col("k") == "FINISH", "SUCCESS").when(F.col("k") == "FAIL", "FAILURE").when(F.col("k") == "START", "PENDING").otherwise("RUNNING")
    s = frame(spark, sf, "task_log").groupBy("task_id").agg(F.max_by("kind", "ts").alias("k")).select("task_id", status.alias("status"))
    running = s.agg(F.count_if(F.col("status") == "RUNNING").alias("running"))  # one row
    return s.join(F.broadcast(running)).select("task_id", "status", ((F.col("status") == "PENDING") & (F.col("running") == 0)).alias("may_start"), (F.col("status") == "RUNNING").alias("may_stop"), (F.col("status") != "RUNNING").alias("may_delete"))


@query("merge_span_predictions", duck("SELECT doc, answer, sum(score) AS score, CAST(count(*) AS BIGINT) AS n_positions FROM (SELECT p_partkey % 100 AS doc, p_brand AS answer, p_size AS score FROM {part}) GROUP BY ALL"))
def merge_span_predictions(spark, sf):
    p = frame(spark, sf, "part").select((F.col("p_partkey") % 100).alias("doc"), F.col("p_brand").alias("answer"), F.col("p_size").alias("score"), F.array("p_partkey").alias("positions"))
    return p.groupBy("doc", "answer").agg(F.sum("score").alias("score"), F.size(F.flatten(F.collect_list("positions"))).cast("long").alias("n_positions"))


@query("span_threshold", duck("SELECT doc_id, string_agg(answer, '|' ORDER BY s) AS answers FROM (SELECT doc_id, answer, min(s) AS s FROM (SELECT doc_id, s, substr(text, s + 1, 6) AS answer, (doc_id * 7 + s) % 10 / 10.0 AS score FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 6)) AS s FROM {documents})) WHERE score > 0.3 GROUP BY ALL) GROUP BY doc_id"))
def span_threshold(spark, sf):
    """The distinct answers of each text's spans, six characters each from its start to its end, that score above 0.3."""
    docs = frame(spark, sf, "documents")
    spans = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,6}"), F.lit(0)), lambda x, n: F.struct((n * 6).alias("s"), x.alias("answers")))
    good = F.filter(spans, lambda x: (F.col("doc_id") * 7 + x["s"]) % 10 / 10.0 > 0.3)
    return R.joined_distinct(docs.select("doc_id", good.alias("spans")), "doc_id", "spans", "|")
