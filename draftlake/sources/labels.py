"""Rows of labelled spans (id, instruction, start, end, target) in three file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "|&&|"  # fixed value
SCHEMA = "id string, instruction string, start array<int>, end array<int>, target string"
COLUMNS = ("id", "instruction", "start", "end", "target")


def _lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.from_json(c, "array<int>") for c in ("start", "end")})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines id, ["instruction"], [starts], [ends], target with tabs between them; lines with too few fields are an error."""
    parts = F.split("value", "\t", 5)
    rows = spark.read.text(path).withColumn("p", F.when(F.size(parts) == 5, parts).otherwise(F.raise_error(F.concat(F.lit("five fields are wanted: "), "value")).cast("array<string>")))
    fields = [F.trim(F.col("p")[0]).alias("id"), F.regexp_extract(F.col("p")[1], r"(?s)^..(.*)..$", 1).alias("instruction"), F.col("p")[2].alias("start"), F.col("p")[3].alias("end"), F.trim(F.col("p")[4]).alias("target")]
    return _lists(rows.select(*fields))


def write_json(rows: DataFrame, path: str, first: int = 0) -> None:
    """One JSON object a line, non-ASCII letters kept; only the first rows by id if first is not 0."""
    (rows.orderBy("id").limit(first) if first else rows).select(*COLUMNS).write.option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def write_delimited(rows: DataFrame, path: str) -> None:
    """A header and lines with the separator between trimmed fields; fields must not hold it or line feeds."""
    text = [F.trim(F.to_json(c) if c in ("start", "end") else F.coalesce(c, F.lit(""))).alias(c) for c in COLUMNS]
    odd = F.concat(*(F.col(c) for c in COLUMNS))
    bad = F.contains(odd, F.lit(SEPARATOR)) | F.contains(odd, F.lit("\n"))
    flat = rows.select(*text).withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("a field holds a separator: "), "id"))).otherwise(F.col("id")))
    flat.write.option("sep", SEPARATOR).option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", SEPARATOR).option("header", True).option("quote", "").schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path)
    return _lists(rows.na.fill("", ["instruction", "target"]))
