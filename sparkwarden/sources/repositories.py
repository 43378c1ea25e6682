"""Repositories as tables: listings and texts from checked-out folders, lists of names, and resumable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.text import parsed_repository
from sparkwarden.operators.selection import MAX_FILE_CHARS


def checked_out(spark: SparkSession, root: str) -> DataFrame:
    """Rows (repo_id, path, size, content) of all files below root/<repo_id>/. Binary files (with a NUL) have a null content; long ones are cut."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    base = "/" + root.split(":")[-1].strip("/") + "/"
    rel = F.substring(tail, F.lit(len(base) + 1), F.length(tail))
    text = F.make_valid_utf8(F.col("content").cast("string"))  # bytes that are no text become the replacement character
    cut = F.substring(text, F.lit(1), F.lit(MAX_FILE_CHARS))
    out = files.select(F.regexp_extract(rel, "^([^/]+)/", 1).alias("repo_id"), F.regexp_replace(rel, "^[^/]+/", "").alias("path"), F.col("length").alias("size"), F.when(~text.contains("\0"), cut).alias("content"))
    return out.filter(~F.col("path").rlike(r"(^|/)\.git/"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (owner, repo) of a text file of repositories, without blank lines, comments and what is no repository."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(^|\s)#.*$", "")).alias("line")).filter("line <> ''")
    return lines.select(parsed_repository(F.col("line")).alias("r")).filter("r IS NOT NULL").select("r.*")


def todo(repositories: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Repositories that have no result yet; failures are tried again."""
    return repositories.join(results.filter("verdict <> 'error'").select(*key), key, "left_anti")
