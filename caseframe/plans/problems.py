"""Queries of the general data problems (p1, p2, p3, p6). Each covers its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.operators import hierarchy, orphans, weighted, wide
from caseframe.session import load


def _wide(spark: SparkSession, d: str, tbl: str, entity: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    columns = wide.declared(load(spark, d, "wide_columns"), tbl)
    return wide.wide(load(spark, d, tbl), columns, entity), columns


def p1_filesystems_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "filesystems", "iosource")[0]


def p1_xattr_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "xattr", "inode_id")[0]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for tbl, entity in (("filesystems", "iosource"), ("xattr", "inode_id")):
        table, columns = _wide(spark, d, tbl, entity)
        out.append(wide.filled(table, entity, columns).select(F.lit(tbl).alias("tbl"), "entity", "column_name"))
    return out[0].unionByName(out[1])


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "logicalindexoffsets").select("inode_id", F.col("word_id").cast("long").alias("word_id"), "offset", "length", "loaded")


def p2_by_word(spark: SparkSession, d: str) -> DataFrame:
    """Per word: hits, distinct inodes, first and last offset, the inode with most hits. Repeated rows count once."""
    w = weighted.compress(_hits(spark, d).distinct(), "word_id", "inode_id", "offset")
    return weighted.per_key(w, "word_id", "inode_id").select("word_id", "hits", F.col("distinct_values").alias("inodes"), F.col("first_pos").alias("first_offset"), F.col("last_pos").alias("last_offset"), F.col("mode").alias("top_inode"), F.col("mode_hits").alias("top_hits"))


def p2_by_inode(spark: SparkSession, d: str) -> DataFrame:
    """Per inode: hits (a null word is a hit of no word), distinct words, first and last offset, the word with most hits."""
    w = weighted.compress(_hits(spark, d).distinct(), "inode_id", "word_id", "offset")
    return weighted.per_key(w, "inode_id", "word_id").select("inode_id", "hits", F.col("distinct_values").alias("words"), F.col("first_pos").alias("first_offset"), F.col("last_pos").alias("last_offset"), F.col("mode").alias("top_word"), F.col("mode_hits").alias("top_hits"))


def p2_offset_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of the offsets of each word's stored hits."""
    w = weighted.compress(_hits(spark, d), "word_id", "offset")
    return weighted.weighted_percentiles(w, "word_id", "offset", [0.25, 0.5, 0.75])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    share = 0.01
    words = weighted.heavy_keys(hits, "word_id", "inode_id", share).select(F.lit("word_id").alias("key_field"), F.col("word_id").alias("key_id"))
    inodes = weighted.heavy_keys(hits, "inode_id", "word_id", share).select(F.lit("inode_id").alias("key_field"), F.col("inode_id").alias("key_id"))
    return words.unionByName(inodes)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.Hierarchy(load(spark, d, "tree")).circular


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.Hierarchy(load(spark, d, "tree")).paths()


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.Hierarchy(load(spark, d, "tree")).lineages())


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def _references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    t = {n: load(spark, d, n) for n in ("whois_routes", "whois", "whois_sources", "logicalindexoffsets", "dictionary", "ftp_commands", "ftp_sessions")}
    return [
        orphans.Reference("whois_routes", t["whois_routes"], "whois_id", t["whois"], "whois", "id"),
        orphans.Reference("whois", t["whois"], "src_id", t["whois_sources"], "whois_sources", "id", since=False),
        orphans.Reference("logicalindexoffsets", t["logicalindexoffsets"], "word_id", t["dictionary"], "dictionary", "id"),
        orphans.Reference("ftp_commands", t["ftp_commands"], "ftp_session_id", t["ftp_sessions"], "ftp_sessions", "inode_id"),
    ]


def _with_purge(spark: SparkSession, d: str, found: DataFrame, refs: str) -> DataFrame:
    purged = load(spark, d, "purged").groupBy(F.col("tbl").alias("target"), F.col("key_id").alias("ref_id")).agg(F.min("purged_at").alias("purged_at"))
    return found.join(purged, ["target", "ref_id"], "left").select("tbl", "ref_id", "period", refs, "state", F.col("purged_at").isNotNull().alias("purged"))


def p6_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys per table and month, with the number of all references to them in it, why, and whether a purge explains the absence."""
    return _with_purge(spark, d, orphans.orphans(_references(spark, d), _month), "refs")


def p6_orphan_references(spark: SparkSession, d: str) -> DataFrame:
    """The same keys and months with the number of references that are orphans, repeated rows once."""
    return _with_purge(spark, d, orphans.orphan_references(_references(spark, d), _month), "orphan_refs")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys and all references to them per table and month."""
    return p6_orphans(spark, d).groupBy("tbl", "period").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("refs").alias("refs"), F.sum(F.col("purged").cast("long")).alias("purged_keys"))


def p6_reference_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys and orphan references per table and month."""
    return p6_orphan_references(spark, d).groupBy("tbl", "period").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("orphan_refs").alias("orphan_refs"), F.sum(F.col("purged").cast("long")).alias("purged_keys"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_references(spark, d), _month).select("tbl", "ref_id", "period")


QUERIES = {f.__name__: f for f in (p1_filesystems_wide, p1_xattr_wide, p1_found, p2_by_word, p2_by_inode, p2_offset_percentiles, p2_found, p3_hierarchy, p3_descendants, p3_found, p6_orphans, p6_report, p6_orphan_references, p6_reference_report, p6_found)}
