"""Chunks, an index of them, and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import PLAIN, chunks
from .nearest import nearest  # noqa: F401

#: Fixed values
SENTENCE_END = "([。！？.!?…][”’\"」』]{0,2})"
RANK_OFFSET = 60  # of reciprocal rank fusion


def sentences(text: Column) -> Column:
    """Pieces that end behind sentence marks and closing quotes, trimmed, none empty."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentences_long(text: Column, size: int) -> Column:
    """Sentences; those over size are cut again at commas, then at line feeds, then at spaces."""
    out = sentences(text)
    for pattern in ("(?<=[,，;；])", "\n", " "):
        again = F.transform(out, lambda s, p=pattern: F.when(F.length(s) > size, F.split(s, p)).otherwise(F.array(s)))
        out = F.filter(F.transform(F.flatten(again), lambda s: F.trim(s)), lambda s: s != "")
    return out


def chunk_table(docs: DataFrame, cut: Column, id_col: str = "doc_id") -> DataFrame:
    """One row for each chunk: its number, text, id (from document and number) and metadata."""
    rows = docs.select("*", F.posexplode(cut).alias("seq", "chunk"))
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("seq").cast("string")))
    return rows.withColumn("chunk_id", key)


def small_to_big(parents: DataFrame, size: int, id_col: str = "chunk_id", text_col: str = "chunk") -> DataFrame:
    """The smaller chunks (parent_id, seq, chunk_id, chunk) of chunks; a hit among them leads back by parent_id."""
    big = parents.select(F.col(id_col).alias("parent_id"), F.col(text_col).alias("text"))
    return chunk_table(big, chunks(F.col("text"), size, 0, PLAIN, before=True, squeeze=False), "parent_id").select("parent_id", "seq", "chunk_id", "chunk")


def parents_of(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """The chunks that small hits (query_id, parent_id, rank) lead to, each once a query, in the order of its best hit."""
    best = hits.groupBy("query_id", "parent_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "parent_id"))
    return best.join(parents.select(F.col("chunk_id").alias("parent_id"), "chunk"), "parent_id").select("query_id", "parent_id", "chunk", place.alias("place"))


def replace_by_source(index: DataFrame, fresh: DataFrame, source: str = "source") -> DataFrame:
    """index without the chunks of the sources in fresh, and fresh."""
    return index.join(fresh.select(source).distinct(), source, "left_anti").unionByName(fresh)


def rank_fusion(lists: DataFrame, keys: tuple[str, ...] = ("query_id", "text")) -> DataFrame:
    """Sum of weight / (60 + rank) over ranked lists (list, weight, rank); ties to the first list and rank."""
    return lists.groupBy(*keys).agg(F.sum(F.col("weight") / (RANK_OFFSET + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def distinct_by_content(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text."""
    first = df.groupBy(text).agg(F.min(F.struct(*order, *(c for c in df.columns if c not in order and c != text))).alias("r"))
    return first.select(text, "r.*")


def paragraphs(text: Column) -> Column:
    """(title, content) of text whose titles are lines **title**."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"(?s)(\n\*\*[^\n]*?\*\*\n.*?(?=\n\*\*[^\n]*?\*\*\n|\z))"), 1)
    title = r"(?s)^\n\*\*([^\n]*?)\*\*\n(.*)$"
    return F.transform(found, lambda p: F.struct(F.regexp_extract(p, title, 1).alias("title"), F.regexp_extract(p, title, 2).alias("content")))


def table_text(cells: Column) -> Column:
    """Rows of cells as lines a|b|c."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "|", "")), "\n")


def retrieve(lists: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, id, place: the k best of ranked lists (query_id, list, id, rank) of several variants and retrievers of a question.

    Questions with several lists are fused by reciprocal ranks, ties to the first list and rank; those with one keep its order, each id once.
    """
    several = lists.groupBy("query_id").agg(F.countDistinct("list").alias("lists"))
    fused = rank_fusion(lists.withColumn("weight", F.lit(1.0)), ("query_id", "id")).join(several, "query_id")
    score = F.when(F.col("lists") > 1, F.round("score", digits))  # one list: its own order
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    return fused.withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_id", "id", "place")
