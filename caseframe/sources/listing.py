"""File listings: directories, entries and their objects, from tables of files or a storage folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import text


def _folder(path: str) -> str:
    return "/" + path.strip("/") + "/" if path.strip("/") else "/"


def ls(files: DataFrame, inodes: DataFrame, path: str) -> DataFrame:
    """Entries of one directory with their objects' size and time."""
    return files.filter(F.col("path") == _folder(path)).select("inode_id", "name", "status").join(inodes.select("inode_id", "size", "mtime"), "inode_id", "left")


def directories(files: DataFrame, path: str) -> DataFrame:
    """Names of the directories right below one."""
    base = _folder(path)
    below = files.select("path").distinct().filter(F.col("path").startswith(base) & (F.col("path") != base))
    return below.select(F.substring_index(F.expr(f"substring(path, {len(base) + 1})"), "/", 1).alias("name")).distinct()


def stat(files: DataFrame, inodes: DataFrame, names: DataFrame) -> DataFrame:
    """inode_id, full_name, status, size of the given full names."""
    full = files.select("inode_id", F.concat("path", "name").alias("full_name"), "status")
    return full.join(names.select("full_name").distinct(), "full_name", "left_semi").join(inodes.select("inode_id", "size"), "inode_id", "left").select("inode_id", "full_name", "status", "size")


def exists(files: DataFrame, full_name: str) -> bool:
    return not files.filter(F.concat("path", "name") == full_name).limit(1).isEmpty()


def walk(files: DataFrame, pattern: str) -> DataFrame:
    """Distinct full names by a glob."""
    return files.select(F.concat("path", "name").alias("full_name")).filter(F.col("full_name").rlike(text.glob_regex(pattern))).distinct()


def storage(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """path, name, size, mtime[, content] of the files of a folder on any file system that Spark reads, below it too. Opening
    by URL scheme is Spark's own; gzip text is unpacked by the text reader."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    out = rows.select(F.regexp_replace("path", "[^/]*$", "").alias("path"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    return out
