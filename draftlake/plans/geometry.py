"""Queries on boxes, segments and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import geometry as G
from .fixtures import duck, frame
from .registry import query

_IN = "o.drawing_id = i.drawing_id AND o.minx < i.minx AND o.miny < i.miny AND o.maxx > i.maxx AND o.maxy > i.maxy"
_DEPTH = f"(SELECT i.drawing_id, i.ent_id, i.minx, i.miny, i.maxx, i.maxy, count(o.ent_id) AS depth FROM {{ent}} i LEFT JOIN {{ent}} o ON {_IN} GROUP BY ALL)"


@query("nesting_depth", duck(f"SELECT drawing_id, ent_id, depth FROM {_DEPTH} d"))
def nesting_depth(spark, sf):
    return G.nesting_depth(frame(spark, sf, "ent")).select("drawing_id", "ent_id", "depth")


@query("depth_one_frames", duck(f"SELECT drawing_id, ent_id, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY miny, minx, ent_id) AS INT) AS number FROM {_DEPTH} d WHERE depth = 1"))
def depth_one_frames(spark, sf):
    deep = G.nesting_depth(frame(spark, sf, "ent")).filter("depth = 1")
    return G.numbered(deep).select("drawing_id", "ent_id", "number")


@query("texts_in_box", duck(f"SELECT i.drawing_id, o.ent_id AS box_id, i.ent_id AS text_id, i.text FROM {{txt}} i JOIN {{ent}} o ON {_IN}"))
def texts_in_box(spark, sf):
    pairs = G.contained_pairs(frame(spark, sf, "ent"), frame(spark, sf, "txt"))
    return pairs.select("drawing_id", F.col("o_ent_id").alias("box_id"), F.col("ent_id").alias("text_id"), "text")


@query("lines_in_box", duck("SELECT o.drawing_id, o.ent_id AS box_id, count(*) AS n_lines FROM {seg} s JOIN {ent} o ON o.drawing_id = s.drawing_id AND o.minx < least(s.x1, s.x2) AND o.miny < least(s.y1, s.y2) AND o.maxx > greatest(s.x1, s.x2) AND o.maxy > greatest(s.y1, s.y2) GROUP BY ALL"))
def lines_in_box(spark, sf):
    s = frame(spark, sf, "seg").select("drawing_id", "seg_id", F.least("x1", "x2").alias("minx"), F.least("y1", "y2").alias("miny"), F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"))
    lines = C.counts_inside(frame(spark, sf, "ent"), s, ["drawing_id", "ent_id"]).filter("n > 0")
    return lines.select("drawing_id", F.col("ent_id").alias("box_id"), F.col("n").alias("n_lines"))


@query("innermost_boxes", duck(f"""WITH hit AS (SELECT * FROM {{txt}} WHERE contains(text, 'the') OR contains(text, 'que')),
    k AS (SELECT * FROM {{ent}} WHERE ent_id IN (SELECT o.ent_id FROM hit i JOIN {{ent}} o ON {_IN}))
    SELECT DISTINCT drawing_id, minx, miny, maxx, maxy FROM k WHERE ent_id NOT IN (SELECT o.ent_id FROM k i JOIN k o ON {_IN})"""))
def innermost_boxes(spark, sf):
    return G.innermost(frame(spark, sf, "ent"), frame(spark, sf, "txt"), ["the", "que"])


@query("filter_type", duck("SELECT ent_id, drawing_id FROM {ent} WHERE ent_id % 4 IN (0, 2)"))
def filter_type(spark, sf):
    types = spark.createDataFrame([(0, "AcDbLine"), (1, "AcDbPolyline"), (2, "AcDbText"), (3, "AcDbMText")], "type_id int, type_name string")
    wanted = types.filter(F.col("type_name").isin("AcDbLine", "AcDbText"))
    return frame(spark, sf, "ent").withColumn("type_id", (F.col("ent_id") % 4).cast("int")).join(wanted, "type_id", "left_semi").select("ent_id", "drawing_id")


@query("filter_rect", duck("SELECT ent_id, drawing_id, minx > 2000 AND miny > 2000 AND maxx < 6000 AND maxy < 6000 AS inside FROM {ent} WHERE maxx >= 2000 AND minx <= 6000 AND maxy >= 2000 AND miny <= 6000"))
def filter_rect(spark, sf):
    inside = (F.col("minx") > 2000) & (F.col("miny") > 2000) & (F.col("maxx") < 6000) & (F.col("maxy") < 6000)
    return frame(spark, sf, "ent").filter("maxx >= 2000 AND minx <= 6000 AND maxy >= 2000 AND miny <= 6000").select("ent_id", "drawing_id", inside.alias("inside"))


@query("filter_point", duck("SELECT ent_id, drawing_id FROM {ent} WHERE minx - 5 <= 5000 AND maxx + 5 >= 5000 AND miny - 5 <= 5000 AND maxy + 5 >= 5000"))
def filter_point(spark, sf):
    return frame(spark, sf, "ent").filter("minx - 5 <= 5000 AND maxx + 5 >= 5000 AND miny - 5 <= 5000 AND maxy + 5 >= 5000").select("ent_id", "drawing_id")


@query("bounds_contains", duck(f"SELECT i.ent_id, ({_IN}) AS inside FROM {{ent}} i JOIN {{ent}} o ON o.ent_id = i.ent_id + 100"))
def bounds_contains(spark, sf):
    e = frame(spark, sf, "ent")
    o = e.select((F.col("ent_id") - 100).alias("ent_id"), *(F.col(c).alias(f"o_{c}") for c in G.BOX))
    return e.join(o, "ent_id").select("ent_id", G.contains().alias("inside"))


@query("bounds_ops", duck("SELECT ent_id, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy, maxx - minx AS width, maxy - miny AS height, (minx + maxx) / 2 - (maxx - minx) * 1.5 / 2 AS s_minx, (miny + maxy) / 2 - (maxy - miny) * 1.5 / 2 AS s_miny, (minx + maxx) / 2 + (maxx - minx) * 1.5 / 2 AS s_maxx, (miny + maxy) / 2 + (maxy - miny) * 1.5 / 2 AS s_maxy FROM {ent}"))
def bounds_ops(spark, sf):
    return G.with_measures(frame(spark, sf, "ent"), 1.5).drop("drawing_id", *G.BOX)


@query("bounds_union", duck("SELECT drawing_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM {ent} GROUP BY drawing_id"))
def bounds_union(spark, sf):
    return frame(spark, sf, "ent").groupBy("drawing_id").agg(*((F.min if c[:3] == "min" else F.max)(c).alias(c) for c in G.BOX))


@query("is_ring_rectangle", duck("SELECT ent_id, ent_id % 7 <> 0 AS is_rectangle FROM {ent}"))
def is_ring_rectangle(spark, sf):
    """Every seventh ring has one corner moved."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), y.cast("double").alias("y"))
    moved = F.col("maxy") + F.when(F.col("ent_id") % 7 == 0, 3).otherwise(0)
    ring = F.array(p("minx", F.col("miny")), p("minx", F.col("maxy")), p("maxx", moved), p("maxx", F.col("miny")), p("minx", F.col("miny")))
    return frame(spark, sf, "ent").select("ent_id", G.is_ring_rectangle(ring).alias("is_rectangle"))


@query("axis_segments", duck("SELECT seg_id, kind AS orientation FROM {seg} UNION ALL SELECT ent_id * 4 + 1000000000, CASE WHEN ent_id % 3 = 0 THEN 'H' ELSE 'V' END FROM {ent} WHERE ent_id % 3 < 2"))
def axis_segments(spark, sf):
    """The sides of the boxes, and a line, an upright and a slanted stroke in turn."""
    slant = frame(spark, sf, "ent").select("drawing_id", (F.col("ent_id") * 4 + 1000000000).alias("seg_id"), F.lit("?").alias("kind"), F.col("minx").alias("x1"), F.col("miny").alias("y1"), F.expr("minx + CASE WHEN ent_id % 3 = 1 THEN 0 ELSE 9 END").alias("x2"), F.expr("miny + CASE WHEN ent_id % 3 = 0 THEN 0 ELSE 7 END").alias("y2"))
    return G.axis_segments(frame(spark, sf, "seg").union(slant)).select("seg_id", "orientation")


@query("rect_from_segments", duck("""WITH v AS (SELECT drawing_id, x1 AS x, y1, y2, min(seg_id) AS id FROM {seg} WHERE kind = 'V' GROUP BY ALL), h AS (SELECT drawing_id, y1 AS y, x1, x2, min(seg_id) AS id FROM {seg} WHERE kind = 'H' GROUP BY ALL)
    SELECT l.drawing_id, l.x AS minx, l.y1 AS miny, r.x AS maxx, l.y2 AS maxy, l.id AS left_id, t.id AS top_id, r.id AS right_id, b.id AS bottom_id
    FROM v l JOIN h t ON t.drawing_id = l.drawing_id AND t.x1 = l.x AND t.y = l.y2 JOIN v r ON r.drawing_id = l.drawing_id AND r.x = t.x2 AND r.y1 = l.y1 AND r.y2 = l.y2
    JOIN h b ON b.drawing_id = l.drawing_id AND b.x1 = l.x AND b.x2 = r.x AND b.y = l.y1"""))
def rect_from_segments(spark, sf):
    return G.rectangles(frame(spark, sf, "seg"))


@query("slope_sign", duck("SELECT id, side FROM {stroke} UNION ALL SELECT id, 'pole' FROM {pole}"))
def slope_sign(spark, sf):
    s = frame(spark, sf, "stroke")
    falls = F.col("side") == "left"
    strokes = s.select("id", F.col("minx").cast("double").alias("x1"), F.when(falls, F.col("maxy")).otherwise(F.col("miny")).cast("double").alias("y1"), F.col("maxx").cast("double").alias("x2"), F.when(falls, F.col("miny")).otherwise(F.col("maxy")).cast("double").alias("y2"))
    poles = frame(spark, sf, "pole").selectExpr("id", "CAST(minx AS DOUBLE) AS x1", "CAST(y AS DOUBLE) AS y1", "CAST(maxx AS DOUBLE) AS x2", "CAST(y AS DOUBLE) AS y2")
    return G.slope_sign(strokes.union(poles)).select("id", "side")


@query("text_contains_any", duck("SELECT doc_id, contains(text, 'tion the') OR contains(text, ' und ') OR contains(text, 'ñ') AS hit FROM {documents}"))
def text_contains_any(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", G.text_contains_any(F.col("text"), ["tion the", " und ", "ñ"]).alias("hit"))


@query("bounds_anchor", duck("""WITH g AS (SELECT ent_id, minx, miny, maxx + (maxx - minx) * 3.0 AS x, maxy + (maxy - miny) * 0.5 AS y FROM {txt})
    SELECT ent_id, (minx + x) / 2 - (x - minx) * 1.2 / 2 AS c_minx, (miny + y) / 2 - (y - miny) * 1.2 / 2 AS c_miny, (minx + x) / 2 + (x - minx) * 1.2 / 2 AS c_maxx, (miny + y) / 2 + (y - miny) * 1.2 / 2 AS c_maxy FROM g"""))
def bounds_anchor(spark, sf):
    return G.anchor_box(frame(spark, sf, "txt").select("ent_id", *G.BOX), 3.0, 0.5, 1.2).drop(*G.BOX)


@query("crop_plan", duck("SELECT drawing_id, ent_id, 1024 AS width, CAST(round_even(1024 * (maxy - miny) / (maxx - minx), 0) AS BIGINT) AS height, md5(concat_ws(',', minx, miny, maxx, maxy)) AS name, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY miny, minx, ent_id) AS INT) AS number FROM {ent}"))
def crop_plan(spark, sf):
    return G.crop_plan(frame(spark, sf, "ent"), 1024)


@query("distinct_boxes", duck("SELECT DISTINCT drawing_id, CAST(floor(minx / 2000) AS BIGINT) AS gx, CAST(floor(miny / 2000) AS BIGINT) AS gy FROM {ent}"))
def distinct_boxes(spark, sf):
    return frame(spark, sf, "ent").select("drawing_id", F.floor(F.col("minx") / 2000).alias("gx"), F.floor(F.col("miny") / 2000).alias("gy")).dropDuplicates()


@query("submap_order", duck("SELECT drawing_id, ent_id, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY miny, minx, ent_id) AS INT) AS number FROM {ent}"))
def submap_order(spark, sf):
    return G.numbered(frame(spark, sf, "ent")).select("drawing_id", "ent_id", "number")


@query("text_proximity", duck("""WITH c AS (SELECT *, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM {ent}),
    p AS (SELECT a.drawing_id, a.ent_id AS a_id, b.ent_id AS b_id, sqrt(power(greatest(a.minx - b.maxx, b.minx - a.maxx, 0), 2) + power(greatest(a.miny - b.maxy, b.miny - a.maxy, 0), 2)) AS gap
      FROM c a JOIN c b ON a.drawing_id = b.drawing_id AND a.ent_id < b.ent_id AND power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2) <= 40000)
    SELECT * FROM p WHERE gap <= 100"""))
def text_proximity(spark, sf):
    return G.near_pairs(frame(spark, sf, "ent"), 100.0)
