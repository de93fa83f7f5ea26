"""Values of floor plans: which area belongs to a label, and where its number stands.

All texts have drawing_id, ent_id, text and a box.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import written
from . import rows as R
from .firsts import first_matches

FONTS, WIDTHS = 20, 5  # fixed values: an area text is within so many font heights and label widths
BELOW = 5000  # fixed value: how far below a header its number may stand
COLONS = (":", "：")
FEW_TAKERS = 200_000  # drawings that take rows of others: up to so many are sent to all tasks


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def nearest_area(labels: DataFrame, areas: DataFrame, font: float = 10, width: float | None = None) -> DataFrame:
    """(label_id, area_id): for each label the topmost area text within 20 font heights up and down and five label widths to both sides."""
    up, wide = FONTS * font, WIDTHS * (F.lit(width) if width is not None else F.col("maxx") - F.col("minx"))
    label = labels.select("drawing_id", F.col("ent_id").alias("label_id"), F.col("miny").alias("y"), (F.col("minx") - wide).alias("x1"), (F.col("maxx") + wide).alias("x2"), _cells(F.col("miny") - up, F.col("miny") + up, 256).alias("cell"))
    area = areas.select("drawing_id", "ent_id", "minx", "miny", "maxy", F.floor(F.col("miny") / 256).alias("cell"))
    close = lambda q, p, i, j: (np.abs(p["miny"][j] - q["y"][i]) <= up) & (p["minx"][j] >= q["x1"][i]) & (p["minx"][j] <= q["x2"][i])
    hit = first_matches(label, area, [("maxy", "descending"), ("ent_id", "ascending")], lambda q, p: np.zeros(len(q["y"])), close, ["label_id"], ["ent_id", "maxy"])
    return hit.groupBy("label_id").agg(F.max_by("ent_id", F.struct("maxy", -F.col("ent_id"))).alias("area_id"))


def right_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key_id, value_id): the first text to the right of each key within its height, colons aside."""
    k = keys.select("drawing_id", F.col("ent_id").alias("key_id"), F.col("maxx").alias("right"), F.col("miny").alias("low"), F.col("maxy").alias("high"), _cells(F.col("miny"), F.col("maxy"), 512).alias("cell"))
    v = texts.filter(~F.trim("text").isin(*COLONS)).select("drawing_id", "ent_id", "minx", "miny", "maxy", F.floor(F.col("miny") / 512).alias("cell"))
    within = lambda q, p, i, j: (p["miny"][j] >= q["low"][i]) & (p["maxy"][j] <= q["high"][i])
    hit = first_matches(k, v, [("minx", "ascending"), ("ent_id", "ascending")], lambda q, p: np.searchsorted(p["minx"], q["right"], "right"), within, ["key_id"], ["ent_id", "minx"])
    return hit.groupBy("key_id").agg(F.min_by("ent_id", F.struct("minx", "ent_id")).alias("value_id"))


def topmost_below(above: DataFrame, rows: DataFrame, size: int = 1024) -> DataFrame:
    """For each of above (drawing_id, id, x1, x2, y) the topmost of rows whose maxy lies below y and whose minx in x1 to x2: id, ent_id, maxy."""
    a = above.select("drawing_id", "id", "x1", "x2", "y", _cells(F.col("x1"), F.col("x2"), size).alias("cell"))
    v = rows.select("drawing_id", "ent_id", "minx", "maxy", F.floor(F.col("minx") / size).alias("cell"))
    within = lambda q, p, i, j: (p["minx"][j] >= q["x1"][i]) & (p["minx"][j] <= q["x2"][i])
    hit = first_matches(a, v, [("maxy", "descending"), ("ent_id", "ascending")], lambda q, p: np.searchsorted(-p["maxy"], -q["y"], "right"), within, ["id"], ["ent_id", "maxy"])
    return hit.groupBy("id").agg(F.max_by("ent_id", F.struct("maxy", -F.col("ent_id"))).alias("ent_id"), F.max("maxy").alias("maxy"))


def below_header(headers: DataFrame, numbers: DataFrame, reach: float = BELOW) -> DataFrame:
    """(header_id, value_id): the topmost number below each header, within its reach and its width."""
    h = headers.select("drawing_id", F.col("ent_id").alias("id"), F.col("minx").alias("x1"), F.col("maxx").alias("x2"), F.col("miny").alias("y"))
    found = topmost_below(h, numbers).join(h.select("id", "y"), "id").filter(F.col("maxy") >= F.col("y") - reach)
    return found.select(F.col("id").alias("header_id"), F.col("ent_id").alias("value_id"))


def labelled_areas(texts: DataFrame, font: float = 10) -> DataFrame:
    """(drawing_id, label_id, floor, area) of the floor plans of drawings: titles put together over "~", their floors, the nearest area text of each, and the number
    in it, else to the right of it, else below it.  Titles without a number give none."""
    row = F.floor(F.col("miny") / (2 * font))
    whole = R.merge_tilde_runs(texts.withColumn("row", row), ["drawing_id", "row"])
    titles = whole.withColumn("keys", X.floor_keys(F.col("text"))).filter(F.size("keys") > 0)
    areas = texts.filter(X.is_area_text(F.col("text")))
    paired = nearest_area(titles, areas, font)
    number = X.first_number(F.col("text"))
    of = lambda pairs, key: pairs.join(texts.select(F.col("ent_id").alias("value_id"), number.alias("n")), "value_id").select(F.col(key).alias("area_id"), "n")
    own = areas.select(F.col("ent_id").alias("area_id"), number.alias("own"))
    beside = of(right_of(areas, texts), "key_id").withColumnRenamed("n", "beside")
    under = of(below_header(areas, texts.filter(X.is_number(F.col("text")))), "header_id").withColumnRenamed("n", "under")
    values = own.join(beside, "area_id", "left").join(under, "area_id", "left").select("area_id", F.coalesce("own", "beside", "under").alias("area")).filter("area IS NOT NULL")
    found = titles.select("drawing_id", F.col("ent_id").alias("label_id"), F.explode("keys").alias("key")).join(paired, "label_id").join(values, "area_id")
    return found.select("drawing_id", "label_id", F.regexp_extract("key", r"^(-?\d+)", 1).try_cast("long").alias("floor"), "area").filter("floor IS NOT NULL")


def floor_areas(labelled: DataFrame) -> DataFrame:
    """(drawing_id, floor, area, filled): each floor's area by its first label, gaps filled from the floor below."""
    first = labelled.groupBy("drawing_id", "floor").agg(F.min_by("area", "label_id").alias("area"))
    return R.fill_missing_floors(first, "drawing_id")


def with_layouts(drawings: DataFrame, layouts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (drawing_id, ...) of drawings, with layout 0; a drawing without any takes those of its first layout (drawing_id, layout, child_id) whose child has some."""
    own = rows.join(drawings.select("drawing_id").distinct(), "drawing_id", "left_semi").withColumn("layout", F.lit(0))
    lacking = drawings.select("drawing_id").distinct().join(rows.select("drawing_id").distinct(), "drawing_id", "left_anti")
    children = layouts.join(lacking, "drawing_id", "left_semi")
    filled = children.join(rows.select(F.col("drawing_id").alias("child_id")).distinct(), "child_id", "left_semi")
    first = R.best_row(filled, ["drawing_id"], [F.col("layout"), F.col("child_id")])
    # Many drawings may take the rows of one child, so these are dealt to all tasks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(tasks)).cast("int")).repartition(tasks, "drawing_id", "_salt")
    first = written(first.select(F.col("drawing_id").alias("_parent"), "layout", F.col("child_id").alias("drawing_id")), "takers")
    if first.count() <= FEW_TAKERS:
        taken = F.broadcast(first).join(dealt, "drawing_id")
    else:
        # The size of what is exploded is estimated as that of the rows before, so by it a side far too large would be sent to the driver.
        takers = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        taken = takers.hint("merge").join(dealt, ["drawing_id", "_salt"])
    taken = taken.drop("drawing_id", "_salt").withColumnRenamed("_parent", "drawing_id")
    return own.unionByName(taken.select(own.columns))
