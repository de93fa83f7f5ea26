"""Aggregates, order and sequence operators on texts, floors, marks and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def best_row(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str = "place") -> DataFrame:
    """The first k rows of each key in an order without ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def category_vote(texts: DataFrame, key: str, words: list[str]) -> DataFrame:
    """The word that occurs most in each key's texts; ties go to the earlier listed, no occurrence gives no row."""
    sums = texts.groupBy(key).agg(*(F.sum(X.count_of(F.col("text"), F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)))
    pairs = F.array(*(F.struct(F.col(f"w{i}").alias("n"), F.lit(-i).alias("place"), F.lit(w).alias("word")) for i, w in enumerate(words)))
    best = sums.select(key, F.array_max(pairs).alias("b")).filter("b.n > 0")
    return best.select(key, F.col("b.word").alias("category"), F.col("b.n").alias("votes"))


def mode_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value), F.max("n").alias("n"))


def leading_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The most frequent value; ties go to the one that had that many first."""
    counted = df.withColumn("n", F.row_number().over(Window.partitionBy(key, value).orderBy(*order)))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), *order)).alias(value))


def heights(marks: DataFrame, key: str, basement: Column) -> DataFrame:
    """Greatest elevation, or for basements the depth of the least; -1 without marks."""
    return marks.groupBy(key).agg(F.coalesce(F.max(F.when(~basement, F.col("level"))), F.max(F.when(basement, F.abs("level"))) * 0 + F.abs(F.min(F.when(basement, F.col("level")))), F.lit(-1.0)).alias("height"))


def level_differences(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Levels from high to low with the rounded difference to the next; the lowest has none."""
    order = Window.partitionBy(*keys).orderBy(F.desc("level"), "id")
    return marks.withColumn("difference", F.bround(F.col("level") - F.lead("level").over(order), 2) + 0.0).filter("difference IS NOT NULL")


def fill_missing_floors(floors: DataFrame, key: str) -> DataFrame:
    """Gaps between a key's floors filled with the area of the floor below, marked as filled."""
    above = F.lead("floor").over(Window.partitionBy(key).orderBy("floor"))
    gaps = floors.withColumn("above", above).filter("above > floor + 1").select(key, F.explode(F.sequence(F.col("floor") + 1, F.col("above") - 1)).alias("floor"), "area", F.lit(True).alias("filled"))
    return floors.select(key, "floor", "area", F.lit(False).alias("filled")).unionByName(gaps)


def reading_order(texts: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Texts numbered top to bottom and left to right; a line holds texts whose steps down are at most the tolerance."""
    down = Window.partitionBy(key).orderBy(F.desc("miny"), "minx", "ent_id")
    step = F.coalesce(F.lag("miny").over(down) - F.col("miny") > tolerance, F.lit(False))
    lines = texts.withColumn("new", step.cast("int")).withColumn("line", F.sum("new").over(down)).drop("new")
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("line", "minx", F.desc("miny"), "ent_id")))


def block_text(ordered: DataFrame, key: str) -> DataFrame:
    """One text of each key in reading order: a line feed between lines, nothing within."""
    line = ordered.groupBy(key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), "").alias("t"))
    return line.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda r: r["t"]), "\n").alias("text"))


def merge_tilde_runs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of a row joined over "~" between them, in order of minx; other texts stay as they are.  A run has the box of all its texts and the least id."""
    row = Window.partitionBy(*keys).orderBy("minx", "ent_id")
    joined = (F.col("text") == "~") | F.coalesce(F.lag("text").over(row) == "~", F.lit(False))
    runs = texts.withColumn("new", (~joined).cast("int")).withColumn("run", F.sum("new").over(row))
    parts = F.array_sort(F.collect_list(F.struct("minx", "ent_id", "text")))
    box = [f(c).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max), ("ent_id", F.min)) if c in texts.columns]
    return runs.groupBy(*keys, "run").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "").alias("text"), *box).drop("run")


def joined_in_order(df: DataFrame, keys: list[str], value: str, order: list[str], mark: str) -> DataFrame:
    """The values of each key in order, with a mark between them."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_v"]), mark).alias(value))


def joined_distinct(df: DataFrame, key: str, spans: str, mark: str) -> DataFrame:
    """The distinct texts of each key's spans, an array of (place, text) in order of the places, with a mark between them; keys without spans are left out.

    The spans of a row stay in it; only where several rows have one key, its spans meet in a shuffle.
    """
    place, text = df.schema[spans].dataType.elementType.names
    if df.groupBy(key).count().filter("count > 1").limit(1).count():
        first = df.select(key, F.inline(spans)).groupBy(key, text).agg(F.min(place).alias(place))
        return joined_in_order(first, [key], text, [place], mark)
    return df.filter(F.size(spans) > 0).select(key, F.array_join(F.array_distinct(F.col(spans)[text]), mark).alias(text))


def newest_first(df: DataFrame, ts: str, tie: str, ranges: int = 64) -> DataFrame:
    """Rows numbered from the newest time on in `place`, ties by the tie column, times of null last.

    Hours are dealt to ranges by quantiles, and each range is numbered by itself behind the rows of the newer ones. The
    quantiles only balance the ranges; any cuts give the same numbers.
    """
    at = df.withColumn("_at", F.unix_date(F.col(ts).cast("date")) * 24 + F.hour(ts))
    cuts = sorted({int(c) for c in at.approxQuantile("_at", [i / ranges for i in range(1, ranges)], 1 / ranges)})
    newer = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c > F.col("_at")))
    dealt = at.withColumn("_range", F.when(F.col("_at").isNull(), len(cuts) + 1).otherwise(newer))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most ranges + 1 rows
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(ts), tie))
    return dealt.join(F.broadcast(before), "_range").withColumn("place", within + F.col("_before")).drop("_at", "_range", "_before")


def task_states(messages: DataFrame) -> DataFrame:
    """Status, progress and times of each task after all its messages: the last one decides, progress is the greatest."""
    status = F.when(F.col("kind") == "START", "RUNNING").when(F.col("kind") == "PROGRESS", "RUNNING").when(F.col("kind") == "FINISH", "SUCCESS").when(F.col("kind") == "FAIL", "FAILURE")
    return messages.groupBy("task_id").agg(F.max_by(status, "ts").alias("status"), F.max(F.when(F.col("kind") == "PROGRESS", F.col("value"))).alias("progress"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_messages"))
