"""Project folders: which files they hold, and what XML files say."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import file_identity

#: Suffixes that are read, folders of a project and the scopes that they stand for, disciplines of a building type.
SUFFIXES = (".dwg", ".docx", ".doc", ".xml", ".png")
FOLDERS = {"招标文件": "TENDER", "建筑设计总说明": "BUILDING_DESIGN", "地下室": "BASEMENT", "人防": "DEFENSE", "计价文件": "CCD", "业态": "BUSINESS"}
DISCIPLINES = ("建筑", "结构", "立面")

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


class MissingScope(ValueError):
    """A project lacks a folder."""


def _any_case(suffixes: tuple[str, ...]) -> str:
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def _options(reader, suffixes: tuple[str, ...]):
    return reader.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", _any_case(suffixes))


def _plain(name: Column) -> Column:
    """The value of a folder named key=value, its escapes undone; other names stay."""
    value = F.regexp_replace(name, "^[^=.]+=", "")
    return F.when(name.rlike("^[^=.]+="), F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)).otherwise(name)


def _tagged(files: DataFrame, root: str) -> DataFrame:
    """Files below root/project/folder[/building type/discipline]/...; a folder named key=value counts as value."""
    below = F.regexp_replace(F.col("path"), "^(?:[a-z]+:/*)?/?", "/")
    start = len("/" + root.split(":", 1)[-1].strip("/")) if ":" in root else len("/" + root.strip("/"))
    raw = F.split(F.ltrim(F.substring(below, F.lit(start + 1), F.length(below)), F.lit("/")), "/")
    parts = F.transform(raw, lambda p, k: F.when(k < F.size(raw) - 1, _plain(p)).otherwise(p))
    table = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    named = files.withColumn("_p", parts).withColumn("name", F.element_at("_p", -1))
    business = F.get("_p", F.lit(1)) == "业态"
    named = named.select(
        "path", "name", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).alias("suffix"),
        F.get("_p", F.lit(0)).alias("project"), table[F.get("_p", F.lit(1))].alias("scope"), F.when(business & (F.size("_p") > 3), F.get("_p", F.lit(2))).alias("building_type"),
        F.when(business & (F.size("_p") > 4) & F.get("_p", F.lit(3)).isin(*DISCIPLINES), F.get("_p", F.lit(3))).alias("discipline"), F.array_join("_p", "/").alias("place"),
    )
    return named.withColumn("identity", file_identity(F.col("place"), F.col("name"), F.col("size"))).drop("place")


def project_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, required: tuple[str, ...] = ()) -> DataFrame:
    """Every file with an allowed suffix (letter case aside) below root: path, name, size, modified, suffix, project, scope, building_type, discipline, identity.

    Files outside the known folders have no scope.  A project without any file in a required scope is an error that names up to twenty.  File contents are
    not read.
    """
    found = _tagged(_options(spark.read, suffixes).load(root), root)
    if required:
        wanted = F.explode(F.array(*map(F.lit, required))).alias("scope")
        lack = found.select("project").distinct().select("project", wanted).join(found.select("project", "scope").distinct(), ["project", "scope"], "left_anti")
        if missing := lack.orderBy("project", "scope").limit(20).collect():
            raise MissingScope("; ".join(f"{r['project']} has no {r['scope']}" for r in missing))
    return found


def arriving_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, late: str = "1 day", per_batch: int = 1000) -> DataFrame:
    """The stream of files that come below root, each identity once within the watermark of the time of change."""
    stream = _options(spark.readStream, suffixes).option("maxFilesPerTrigger", per_batch).load(root)
    return _tagged(stream, root).withWatermark("modified", late).dropDuplicatesWithinWatermark(["identity"])


def xml_attributes(spark: SparkSession, root: str) -> DataFrame:
    """(path, seq, line) for each element of each XML file below root in document order: the values of its attributes, joined by "|", nothing without any.

    A file is parsed as its elements begin, and finished ones are dropped.  A file that is not well formed is an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.etree import ElementTree

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                seq, lines = 0, []
                try:
                    for event, node in ElementTree.iterparse(io.BytesIO(content.as_py()), ("start", "end")):
                        if event == "end":
                            node.clear()
                            continue
                        lines.append("|".join(node.attrib.values()))
                        if len(lines) == 8192:
                            yield _lines(path, seq, lines)
                            seq, lines = seq + len(lines), []
                except ElementTree.ParseError as e:
                    raise ValueError(f"{path} is not well formed: {e}") from e
                if lines:
                    yield _lines(path, seq, lines)

    return _options(spark.read, (".xml",)).load(root).select("path", "content").mapInArrow(run, "path string, seq bigint, line string")


def _lines(path: str, seq: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(range(seq, seq + len(lines)), pa.int64()), pa.array(lines)], names=["path", "seq", "line"])
