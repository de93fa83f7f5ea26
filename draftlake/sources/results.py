"""The results of projects as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "struct<chinese_name:string,value:string,candidates:array<string>>"
_TYPED = "struct<chinese_name:string,types:map<string,struct<value:string,candidates:array<string>>>>"
SCHEMA = f"project_name string, general map<string,{_ENTRY}>, business_type map<string,{_TYPED}>, case_time bigint"


def project_documents(values: DataFrame, specs: DataFrame, seconds: DataFrame) -> DataFrame:
    """One row for each project: its general fields and its fields by building type, each with name, value and candidates, and how long it took.

    values: project, field, building_type (null: general), value, candidates.  specs: field, name, general, hidden, fallback; hidden fields
    are left out, a missing or empty value is the fallback, absent candidates are none, a field of the wrong kind is left out.  seconds: project, seconds.
    """
    known = values.join(F.broadcast(specs.filter("NOT hidden")), "field")
    known = known.withColumn("value", F.coalesce(F.nullif("value", F.lit("")), "fallback")).withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    entry = F.struct(F.col("name").alias("chinese_name"), "value", "candidates").cast(_ENTRY)
    general = known.filter("general AND building_type IS NULL").groupBy("project").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", entry)))).alias("general"))
    typed = known.filter("NOT general AND building_type IS NOT NULL").groupBy("project", "field", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("building_type", F.struct("value", "candidates"))))).alias("types"))
    typed = typed.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("name").alias("chinese_name"), "types").cast(_TYPED)))).alias("business_type"))
    whole = values.select("project").distinct().join(general, "project", "left").join(typed, "project", "left").join(seconds, "project", "left")
    empty = lambda kind: F.from_json(F.lit("{}"), f"map<string,{kind}>")
    return whole.select(F.col("project").alias("project_name"), F.coalesce("general", empty(_ENTRY)).alias("general"), F.coalesce("business_type", empty(_TYPED)).alias("business_type"), F.round("seconds").cast("long").alias("case_time"))


def write_results(documents: DataFrame, folder: str, buckets: int = 64) -> None:
    """A JSON line for each project, in folders by the hash of its name; letters that are not ASCII are kept, nulls are written."""
    bucket = F.pmod(F.xxhash64("project_name"), F.lit(buckets)).alias("bucket")
    text = documents.select(bucket, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    text.repartition("bucket").write.partitionBy("bucket").text(folder)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
