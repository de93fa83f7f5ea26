"""Boxes, segments and their joins, one drawing apart from the other.

A box has the columns minx, miny, maxx, maxy; drawings are told by drawing_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import cells as C
from .cells import BOX

LEAST_LEVEL = 6  # cells are never smaller than 2**6


def contains(outer: str = "o_", inner: str = "") -> Column:
    """Strict containment of a box in a box, by column prefixes."""
    o, i = (lambda c, p=p: F.col(f"{p}{c}") for p in (outer, inner))
    return (o("minx") < i("minx")) & (o("miny") < i("miny")) & (o("maxx") > i("maxx")) & (o("maxy") > i("maxy"))


def with_measures(df: DataFrame, share: float) -> DataFrame:
    """Centre, width, height, and the box scaled about its centre."""
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    half_w, half_h = w * share / 2, h * share / 2
    return df.withColumns({"cx": cx, "cy": cy, "width": w, "height": h, "s_minx": cx - half_w, "s_miny": cy - half_h, "s_maxx": cx + half_w, "s_maxy": cy + half_h})


def contained_pairs(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of inner joined with the boxes of outer (columns prefixed o_) that strictly contain them.

    An outer box lies in at most four cells of a grid as wide as its longer side or wider; grids differ by
    powers of two, and few are in use.  An inner box has one cell, that of its lower left corner, in each grid.
    The join is on drawing, grid and cell; no pair comes twice, and large frames make no more
    rows than small ones.
    """
    level = C.level_of(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")), LEAST_LEVEL)
    kept = C.grids(outer, level, 2)
    o = outer.withColumn("level", C.placed(level, kept))
    o = o.withColumn("gx", F.explode(F.sequence(C.at("minx", "level"), C.at("maxx", "level"))))
    o = o.withColumn("gy", F.explode(F.sequence(C.at("miny", "level"), C.at("maxy", "level"))))
    o = o.select(*(F.col(c).alias(f"o_{c}") for c in outer.columns), F.col("drawing_id"), "level", "gx", "gy")
    i = inner.withColumn("level", F.explode(F.array(*map(F.lit, kept))))
    i = i.withColumns({"gx": C.at("minx", "level"), "gy": C.at("miny", "level")})
    return i.join(o, ["drawing_id", "level", "gx", "gy"]).filter(contains()).drop("level", "gx", "gy")


def nesting_depth(boxes: DataFrame) -> DataFrame:
    """boxes with depth, the number of boxes of the drawing that strictly contain each."""
    return C.counts_around(boxes, boxes, boxes.columns).withColumnRenamed("n", "depth")


def numbered(frames: DataFrame) -> DataFrame:
    """Frames numbered in their drawing by (miny, minx), from 1."""
    order = Window.partitionBy("drawing_id").orderBy("miny", "minx", "ent_id")
    return frames.withColumn("number", F.row_number().over(order))


def innermost(boxes: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that contain a text with a key and no other such box, without repeats."""
    return innermost_around(boxes, texts.filter(text_contains_any(F.col("text"), keys))).select("drawing_id", *BOX).dropDuplicates()


def innermost_around(boxes: DataFrame, inner: DataFrame) -> DataFrame:
    """The boxes that contain one of inner and no other box that does."""
    with_key = written(C.counts_inside(boxes, inner, boxes.columns).filter("n > 0").drop("n"), "with_key")
    return C.counts_inside(with_key, with_key, boxes.columns).filter("n = 0").drop("n")


def text_contains_any(text: Column, keys: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(text, k))


def is_ring_rectangle(points: Column, tolerance: float = 1e-6) -> Column:
    """Whether points (x, y), but for a closing one, are four at one distance from their centre."""
    n = F.size(points)
    closing = (n > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    ring = F.when(closing, F.slice(points, 1, n - 1)).otherwise(points)

    def four(p: Column) -> Column:
        cx = F.aggregate(p, F.lit(0.0), lambda a, q: a + q["x"]) / 4
        cy = F.aggregate(p, F.lit(0.0), lambda a, q: a + q["y"]) / 4
        far = F.transform(p, lambda q: F.sqrt(F.pow(q["x"] - cx, 2) + F.pow(q["y"] - cy, 2)))
        return (F.array_max(far) - F.array_min(far)) < tolerance

    return F.coalesce((F.size(ring) == 4) & four(ring), F.lit(False))


def axis_segments(segments: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Segments (x1, y1, x2, y2) along an axis and of some length, with orientation H or V."""
    dx, dy = F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))
    flat, upright = dy <= tolerance, dx <= tolerance
    return segments.filter(flat != upright).withColumn("orientation", F.when(flat, "H").otherwise("V"))


def rectangles(segments: DataFrame) -> DataFrame:
    """Boxes of four segments (kind V or H) that meet at their ends V-H-V-H, each box once, with the least ids of its sides.

    Sides are matched by their end points; each join is on a point of the drawing.
    """
    order = lambda c: F.struct(F.least(F.col(f"{c}1"), F.col(f"{c}2")).alias("a"), F.greatest(F.col(f"{c}1"), F.col(f"{c}2")).alias("b"))
    s = segments.select("drawing_id", "seg_id", "kind", order("x").alias("x"), order("y").alias("y"))
    v = s.filter("kind = 'V'").groupBy("drawing_id", F.col("x.a").alias("x"), F.col("y.a").alias("y1"), F.col("y.b").alias("y2")).agg(F.min("seg_id").alias("id"))
    h = s.filter("kind = 'H'").groupBy("drawing_id", F.col("y.a").alias("y"), F.col("x.a").alias("x1"), F.col("x.b").alias("x2")).agg(F.min("seg_id").alias("id"))
    left = v.select("drawing_id", F.col("x").alias("minx"), F.col("y1").alias("miny"), F.col("y2").alias("maxy"), F.col("id").alias("left_id"))
    top = h.select("drawing_id", F.col("x1").alias("minx"), F.col("x2").alias("maxx"), F.col("y").alias("maxy"), F.col("id").alias("top_id"))
    right = v.select("drawing_id", F.col("x").alias("maxx"), F.col("y1").alias("miny"), F.col("y2").alias("maxy"), F.col("id").alias("right_id"))
    bottom = h.select("drawing_id", F.col("x1").alias("minx"), F.col("x2").alias("maxx"), F.col("y").alias("miny"), F.col("id").alias("bottom_id"))
    found = left.join(top, ["drawing_id", "minx", "maxy"]).join(right, ["drawing_id", "maxx", "miny", "maxy"]).join(bottom, ["drawing_id", "minx", "maxx", "miny"])
    return found.select("drawing_id", *BOX, "left_id", "top_id", "right_id", "bottom_id")


def slope_sign(strokes: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Two-point strokes as left (falling), right (rising) or pole (nearly along the x axis)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    kind = F.when(F.abs(dy) < tolerance, "pole").when(F.abs(dx) < tolerance, None).when(dx * dy < 0, "left").otherwise("right")
    return strokes.withColumn("side", kind).filter("side IS NOT NULL")


def anchor_box(df: DataFrame, wider: float, higher: float, share: float) -> DataFrame:
    """The crop box of a text: wider and higher by so many own widths and heights to the right and up, then scaled about its centre."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    grown = df.withColumns({"a_maxx": F.col("maxx") + w * wider, "a_maxy": F.col("maxy") + h * higher})
    cx, cy = (F.col("minx") + F.col("a_maxx")) / 2, (F.col("miny") + F.col("a_maxy")) / 2
    half_w, half_h = (F.col("a_maxx") - F.col("minx")) * share / 2, (F.col("a_maxy") - F.col("miny")) * share / 2
    return grown.select(*df.columns, (cx - half_w).alias("c_minx"), (cy - half_h).alias("c_miny"), (cx + half_w).alias("c_maxx"), (cy + half_h).alias("c_maxy"))


def crop_plan(boxes: DataFrame, width: int) -> DataFrame:
    """Requests for images of boxes: pixels, a name from the box, and a number in drawing order."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    name = F.md5(F.concat_ws(",", *(F.col(c).cast("long").cast("string") for c in BOX)))
    return numbered(boxes).select("drawing_id", "ent_id", F.lit(width).alias("width"), F.bround(F.lit(width) * h / w).cast("long").alias("height"), name.alias("name"), "number")


def box_gap(p: str = "a_", q: str = "b_") -> Column:
    """Distance of two boxes: between their edges, 0 where they overlap."""
    a, b = (lambda c, s=s: F.col(f"{s}{c}") for s in (p, q))
    dx = F.greatest(a("minx") - b("maxx"), b("minx") - a("maxx"), F.lit(0))
    dy = F.greatest(a("miny") - b("maxy"), b("miny") - a("maxy"), F.lit(0))
    return F.sqrt(F.pow(dx.cast("double"), 2) + F.pow(dy.cast("double"), 2))


def near_pairs(boxes: DataFrame, distance: float) -> DataFrame:
    """Pairs (a_id < b_id) of boxes of one drawing within a distance, whose centres are within twice it."""
    size = 2 * distance
    b = boxes.withColumns({"cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2})
    b = b.withColumns({"gx": F.floor(F.col("cx") / size), "gy": F.floor(F.col("cy") / size)})
    cols = ("ent_id", *BOX, "cx", "cy")
    a = b.select("drawing_id", "gx", "gy", *(F.col(c).alias(f"a_{c}") for c in cols))
    step = F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))
    around = b.withColumn("sx", F.explode(step)).withColumn("sy", F.explode(step))
    around = around.select("drawing_id", (F.col("gx") + F.col("sx")).alias("gx"), (F.col("gy") + F.col("sy")).alias("gy"), *(F.col(c).alias(f"b_{c}") for c in cols))
    pairs = a.join(around, ["drawing_id", "gx", "gy"]).filter("a_ent_id < b_ent_id")
    centres = F.pow(F.col("a_cx") - F.col("b_cx"), 2) + F.pow(F.col("a_cy") - F.col("b_cy"), 2)
    pairs = pairs.filter(centres <= size * size).withColumn("gap", box_gap())
    return pairs.filter(F.col("gap") <= distance).select("drawing_id", F.col("a_ent_id").alias("a_id"), F.col("b_ent_id").alias("b_id"), "gap")
