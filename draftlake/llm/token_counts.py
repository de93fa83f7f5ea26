"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A batch of changes is summed to signed totals and committed once under its name.  Committing a name again changes nothing, so a job
that is run again after a failure is harmless.  The totals are the sum of all commits; they may be
folded into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Folder
from .shared import new_folder, save
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (kind, keys, n_tokens, old_tokens) to signed rows.

    ``insert`` adds a document, ``delete`` takes one away, ``revise`` replaces old_tokens by
    n_tokens.  An absent count is 0; absent keys are keys of their own; other kinds are errors.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    return changes.select(*KEYS, sign.cast("long").alias("n_docs"), F.when(F.col("kind") == "revise", n - old).otherwise(sign * n).cast("long").alias("n_tokens"))


class TokenTotals:
    """The store of committed batches in a folder: sums in folders of their own, and a small file for each commit that names one.

    A commit comes under its name in one step after its sums are written, so a writer that was stopped leaves nothing that counts, and of two
    writers of one batch one counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Folder(spark, f"{self.folder}/commits")

    def _committed(self) -> list[str]:
        return [n for n in self.commits.names() if not n.startswith(".")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if its name is committed already."""
        if batch in self._committed():
            return False
        sums = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        at = f"sums-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{at}")  # a row for each key
        return self.commits.put(batch, at)

    def totals(self) -> DataFrame:
        """Keys with n_docs and n_tokens; keys whose documents are all gone are left out."""
        done = [f"{self.folder}/{self.commits.text(n)}" for n in self._committed()]
        if not done:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*done)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of the text as it is and with white space folded, digest of the text; null counts as empty."""
    name = tokenizer.rsplit(".", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            raw, folded = [], []
            for at in range(0, batch.num_rows, 512):
                texts = batch.column("text").slice(at, 512).to_pylist()
                plain = [" ".join(t.split()) for t in texts]
                own = [len(ids) for ids in code.encode(texts)]
                other = iter(code.encode([p for p, t in zip(plain, texts, strict=True) if p != t]))
                raw += own
                folded += [n if p == t else len(next(other)) for n, p, t in zip(own, plain, texts, strict=True)]
            n = len(raw)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "digest")), pa.array([name] * n), pa.array(raw, pa.int64()), pa.array(folded, pa.int64())], names=["doc_id", "source", "lang", "digest", "tokenizer", "raw", "folded"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.md5(text).alias("digest"))
    return docs.mapInArrow(run, "doc_id long, source string, lang string, digest string, tokenizer string, raw long, folded long")


def document_totals(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Totals after three batches: insert all documents; delete those whose text a smaller id has
    (rows with equal id and text count as one copy each, and none of them goes); revise the rest to their counts with white
    space folded.  The second batch is sent twice, as by a job that was run again."""
    spark = docs.sparkSession
    rows = save(counted(docs, tokenizer), "counted")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = rows.join(first, "digest").withColumn("gone", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marked = save(marked, "marked")
    store = TokenTotals(spark, new_folder(spark, "token_totals"))
    none = F.lit(None).cast("long").alias("old_tokens")
    deletes = marked.filter("gone").select(F.lit("delete").alias("kind"), *KEYS, F.col("raw").alias("n_tokens"), none)
    store.commit("0001-insert", marked.select(F.lit("insert").alias("kind"), *KEYS, F.col("raw").alias("n_tokens"), none))
    store.commit("0002-delete", deletes)
    store.commit("0002-delete", deletes)
    store.commit("0003-revise", marked.filter("NOT gone").select(F.lit("revise").alias("kind"), *KEYS, F.col("folded").alias("n_tokens"), F.col("raw").alias("old_tokens")))
    return store.totals()
