"""Scan a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.snapshots import content_hash, dedup_physical

# What belongs to a corpus.
INCLUDED_EXTENSIONS = (".rb", ".rake", ".erb")
EXCLUDED_DIRS = (".git", "node_modules", "vendor", "tmp", "log", "coverage", "storage")
EXCLUDED_PREFIXES = ("vendor/bundle", "public/assets")


def is_included(
    path: Column,
    extensions: tuple[str, ...] = INCLUDED_EXTENSIONS,
    dirs: tuple[str, ...] = EXCLUDED_DIRS,
    prefixes: tuple[str, ...] = EXCLUDED_PREFIXES,
) -> Column:
    """Whether a path relative to the root is part of the corpus."""
    ext = F.lit(False)
    for e in extensions:
        ext = ext | path.endswith(e)
    parents = F.split(F.regexp_replace(path, "[^/]*$", ""), "/")
    hidden = F.exists(parents, lambda p: p.isin(*dirs))
    outside = F.lit(False)
    for prefix in prefixes:
        outside = outside | path.startswith(prefix + "/")
    return ext & ~hidden & ~outside


def included(files: DataFrame, col: str = "path", **kw) -> DataFrame:
    return files.filter(is_included(F.col(col), **kw))


def corpus_scan(spark: SparkSession, root: str, **kw) -> DataFrame:
    """path, uri, real_path, text, content_hash of every included file."""
    base = root.rstrip("/") + "/"
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{rb,rake,erb}").load(root)
    )
    local = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    named = raw.select(
        F.substr(local, F.lit(len(base) + 1)).alias("path"), F.col("path").alias("uri"), local.alias("real_path"),
        F.decode("content", "UTF-8").alias("text"),
    )
    return dedup_physical(included(named, **kw)).withColumn("content_hash", content_hash("text"))
