"""Files, folders, versions and field tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.sources.scratch import written


def file_identity(path: Column, name: Column, size: Column) -> Column:
    return F.md5(F.concat_ws("|", path, name, size.cast("string")))


def full_paths(tree: DataFrame) -> DataFrame:
    """(id, path, depth) of every node (id, parent, name) under a root; each round joins one more level until none is left.

    A node without a way to a root has no path; an id that has two parents and leads back to itself is an error.  Each level is written before the next one reads it.
    """
    found = level = written(tree.filter("parent IS NULL").select("id", F.col("name").alias("path"), F.lit(0).alias("depth")), "level")
    depth, nodes = 0, tree.count()
    while True:
        depth += 1
        if depth > nodes:
            raise ValueError("an id with two parents leads back to itself")
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("up"))
        level = written(tree.join(up, "parent").select("id", F.concat_ws("/", "up", "name").alias("path"), F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            return found
        found = found.union(level)


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of every node (id, parent) below the nodes of roots (id), each once with its least depth; roots themselves only if they are below one.

    A walk from the roots: each round joins the children of the last level that no round has found, so nodes above and beside are never joined and
    a way that leads back ends.
    """
    edges = tree.select("id", "parent").filter("parent IS NOT NULL")
    level, found, depth = written(roots.select("id").distinct(), "level"), None, 0
    while True:
        depth += 1
        below = edges.join(level.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        fresh = below if found is None else below.join(found.select("id"), "id", "left_anti")
        level = written(fresh.select("id", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.union(level)


def tree_from_paths(paths: DataFrame) -> DataFrame:
    """Rows id, parent, name, kind (D or F) of all prefixes of the paths; ids are digests of the prefixes."""
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("p"), (k == F.size(parts)).alias("leaf")))
    rows = paths.select(F.explode(prefix).alias("x")).groupBy("x.p").agg(F.min("x.leaf").alias("leaf"))
    parent = F.when(F.contains("p", F.lit("/")), F.md5(F.regexp_extract("p", "^(.*)/[^/]*$", 1)))
    return rows.select(F.md5("p").alias("id"), parent.alias("parent"), F.element_at(F.split("p", "/"), -1).alias("name"), F.when(F.col("leaf"), "F").otherwise("D").alias("kind"))


def upsert_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (name, size, version) after new ones (name, size) came: known names (letter case aside) get the next version."""
    o = old.select(F.lower("name").alias("key"), F.col("name").alias("o_name"), F.col("size").alias("o_size"), "version")
    n = new.select(F.lower("name").alias("key"), F.col("name").alias("n_name"), F.col("size").alias("n_size"))
    version = F.when(F.col("n_name").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    return o.join(n, "key", "full").select(F.coalesce("o_name", "n_name").alias("name"), F.coalesce("n_size", "o_size").alias("size"), version.alias("version"))
