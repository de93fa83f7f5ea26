"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import stages
from draftlake.llm.shared import new_folder, table

STAGES = [
    ("language_id", stages.known_language),
    ("line_dedup", stages.fresh_lines),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("benchmark_decontamination", stages.clean_of_benchmarks),
    ("best_fit_packing", stages.packed),
]

#: Language identification is learned, which SQL cannot express; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
