"""Loaders of reference data: known digests, address records, word lists, registry keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions import net, text

NSRL = '"SHA-1","MD5","CRC32","FileName","FileSize","ProductCode","OpSystemCode","SpecialCode"'


def known_digests(lines: DataFrame) -> DataFrame:
    """md5, filename, productcode, oscode of a list of known files (quoted CSV with a header line)."""
    row = F.from_csv("value", "sha1 string, md5 string, crc string, filename string, size string, productcode int, oscode string, special string")
    rows = lines.filter(~F.col("value").startswith('"SHA-1"')).select(row.alias("r"))
    return rows.select(F.unhex("r.md5").alias("md5"), "r.filename", "r.productcode", "r.oscode").filter("md5 is not null")


def registry_records(lines: DataFrame) -> DataFrame:
    """start_ip, numhosts, country, status of ``registry|cc|ipv4|start|count|date|status`` lines; a status is ``allocated`` or
    ``assigned`` if its text says so."""
    p = F.split("value", "[|]")
    rows = lines.filter((F.size(p) >= 7) & (F.get(p, F.lit(2)) == "ipv4") & (F.get(p, F.lit(3)) != "*"))
    status = F.when(F.lower(p[6]).contains("allocated"), "allocated").when(F.lower(p[6]).contains("assigned"), "assigned").otherwise(F.lower(p[6]))
    return rows.select(net.ip_to_long(p[3]).alias("start_ip"), p[4].try_cast("bigint").alias("numhosts"), F.upper(p[1]).alias("country"), status.alias("status"))


def inetnum_records(records: DataFrame) -> DataFrame:
    """start_ip, numhosts and the texts of ``inetnum`` records (column ``value`` holds a whole record)."""
    span = text.first_record_field(F.col("value"), "inetnum")
    low, high = (net.ip_to_long(F.trim(F.regexp_extract(span, r"([\d.]+)\s*-\s*([\d.]+)", i))) for i in (1, 2))
    return records.select(low.alias("start_ip"), (high - low + 1).alias("numhosts"), text.first_record_field(F.col("value"), "netname").alias("netname"), text.record_field(F.col("value"), "descr").alias("descr"),
                          F.upper(text.first_record_field(F.col("value"), "country")).alias("country"), text.record_field(F.col("value"), "admin-c").alias("adminc"), F.lower(text.first_record_field(F.col("value"), "status")).alias("status"))


def word_list(lines: DataFrame, word_class: str = "English") -> DataFrame:
    """word, class, word_type of a list with one word a line; words of under three characters are left out."""
    word = F.trim("value")
    return lines.select(word.alias("word")).filter(F.length("word") >= 3).distinct().select("word", F.lit(word_class).alias("class"), F.lit("word").alias("word_type"))


def registry_keys(lines: DataFrame) -> DataFrame:
    """path, key, description of tab-separated lines."""
    p = F.split("value", "\t")
    return lines.filter(F.size(p) >= 2).select(p[0].alias("path"), p[1].alias("reg_key"), F.get(p, F.lit(2)).alias("description"))
