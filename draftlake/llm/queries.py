"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, language_id, line_dedup, main_text, minhash, packing, sequence_files, sorted_lists, source_audit, token_counts, warc
from .ngram_join import ngram_components
from .oracle import OP1_SQL, OP4_SQL, OP9_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from .shared import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_totals(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op7_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_files.token_sequences(table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fields(warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_lists.top_k(table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_benchmark_decontamination, op3_best_fit_packing, op4_ngram_jaccard_join, op5_token_counts, op6_language_id,
        op7_token_sequences, op8_warc_derivatives, op9_exact_top_k, op10_main_text, op11_source_divergence, op12_minhash_dedup,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op9_exact_top_k": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_minhash_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
