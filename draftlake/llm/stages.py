"""The stages of the corpus pipeline: each takes documents and returns what it keeps of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, ngram_join, packing
from .shared import save, table

LEAST_SCORE = 0.3  # mean posterior below which a language is not known
BROADCAST_IDS = 1_000_000  # of 8 bytes each; above it the join shuffles


def row_key() -> Column:
    """A number of a row's id and text; rows that are alike in both are one document."""
    return F.xxhash64(F.isnull("doc_id"), F.col("doc_id").cast("string"), F.isnull("text"), F.col("text").cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id and text of docs."""
    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but for those with these keys (key)."""
    gone = save(keys.select("key").distinct(), "dropped").toDF("_dropped_key")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, row_key() == F.col("_dropped_key"), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of a language that the field knows; texts, labels and other columns stay as they are.

    Null texts and texts without letters go; an empty table stays empty.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    field = language_id.fit(language_id.training_sample(source))
    # Numbered names, so that no column of docs clashes with those of the judgement.
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    judged = language_id.predict(numbered.withColumn("text", F.col(f"c{docs.columns.index('text')}").cast("string")), field)
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*numbered.columns).toDF(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match earlier ones; those of which nothing is left go.  n_chars follows the text.

    Rows without id come first and are cut like others; null texts stay null.
    """
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    id_, text, n = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "n_chars"))
    found = line_dedup.dedup_lines(numbered, id_, text)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate(text, "\n\t\r", "   ")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(n))
    return found.filter(~F.coalesce(emptied, F.lit(False))).withColumn(n, n_chars).select(*numbered.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked ones; of rows alike in id and text, one.  Rows without id stay.

    Rows are told apart by id and text, so different texts under one id are judged each by itself.
    """
    ids = save(keyed(docs).groupBy("key", "doc_id").count(), "keys")
    groups = save(ngram_join.ngram_components(keyed(docs), "key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("comp")).distinct(), "groups")
    several = groups.filter("key <> comp").select("comp").distinct()
    members = groups.join(several, "comp").join(ids, "key")
    least = members.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least")).select("comp", F.col("least.key").alias("kept"))
    kept = without(docs, members.join(least, "comp").filter("key <> kept AND doc_id IS NOT NULL"))
    if not ids.filter("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        return kept
    whole = kept.select(row_key().alias("_row_key"), *kept.columns)
    return whole.filter("doc_id IS NOT NULL").dropDuplicates(["_row_key"]).union(whole.filter("doc_id IS NULL")).drop("_row_key")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, judged row by row whatever their ids."""
    rows = keyed(docs)
    found = decontaminate.leaks(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("key")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins."""
    return packing.pack(docs)
