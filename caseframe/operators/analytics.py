"""Bandwidth, timelines, stream statistics, banding, pages, drill-down and change signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import dates
from caseframe.operators.running import running


def bandwidth(df: DataFrame, time: str, size: str, seconds: int = 60, start: str | None = None, bins: int | None = None) -> DataFrame:
    """(bin, total) of sizes per time bin; ``start`` and ``bins`` cut out a stretch for a graph."""
    rows = df.select(dates.bin_start(F.col(time), seconds).alias("bin"), F.col(size).alias("_size")).filter("bin is not null")
    if start is not None:
        first = F.unix_timestamp(F.lit(start).cast("timestamp"))
        rows = rows.filter(F.col("bin") >= first)
        if bins is not None:
            rows = rows.filter(F.col("bin") < first + bins * seconds)
    return rows.groupBy("bin").agg(F.sum("_size").alias("total"))


def timeline(df: DataFrame, times: dict[str, str], name: str, key: str) -> DataFrame:
    """(time, name, key, one flag per entry of ``times``): the time columns unpivoted in one scan, and rows of one time and
    name merged; the key is the smallest. Null times are left out."""
    stacked = ", ".join(f"'{flag}', cast({column} as timestamp_ntz)" for flag, column in times.items())
    rows = df.select(F.col(name).alias("name"), F.col(key).alias("key"), F.expr(f"stack({len(times)}, {stacked}) as (flag, time)")).filter("time is not null")
    return rows.groupBy("time", "name").agg(F.min("key").alias("key"), *[F.sum((F.col("flag") == f).cast("long")).alias(f) for f in times])


def outdated(inodes: DataFrame, version: str, size: str, word_version: int, detailed: int = 1 << 30) -> DataFrame:
    """(objects, bytes) whose index version, without the flag for detailed scans, is older than the dictionary's."""
    plain = F.col(version).bitwiseAND(F.lit(~detailed & 0x7FFFFFFF))
    return inodes.filter(plain < word_version).agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def stream_statistics(packets: DataFrame, stream: str = "stream_id", order: str = "id", time: str = "ts", length: str = "length") -> DataFrame:
    """packets, r_jitter, rate, r_data, kbits per stream: correlation and slope of the packet number and of the bytes so far
    against time. Numbers and running bytes come from :func:`running`, so a long stream is spread over many tasks."""
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    numbered = running(packets.withColumn("_t", t), stream, order, {"_i": ("count", F.lit(1)), "_o": ("sum", F.col(length))})
    i, o, s = F.col("_i").cast("double"), F.col("_o").cast("double"), F.col("_t")
    return numbered.groupBy(stream).agg(F.count(F.lit(1)).alias("packets"), F.corr(i, s).alias("r_jitter"), F.regr_slope(i, s).alias("rate"), F.corr(o, s).alias("r_data"), (F.regr_slope(o, s) * 8 / 1000).alias("kbits"))


def banded(df: DataFrame, value: str, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``band`` (0 or 1), which changes whenever the value does in the given order of the whole table. ``value`` must
    not decrease in that order, so a change is a value above all before it."""
    seen = running(df, None, order, {"_before": ("before", F.col(value)), "_n": ("count", F.lit(1))}, ties=ties)
    changed = seen.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(value) > F.col("_before")), 1).otherwise(0))
    return running(changed, None, "_n", {"_bands": ("sum", F.col("_new"))}).withColumn("band", ((F.col("_bands") - 1) % 2).cast("int")).drop("_before", "_n", "_new", "_bands")


def paged(df: DataFrame, order: str, size: int = 50, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``page``, from 1, in the order of the whole table."""
    return running(df, None, order, {"_n": ("count", F.lit(1))}, ties=ties).withColumn("page", F.ceil(F.col("_n") / size).cast("long")).drop("_n")


def page_ends(pages: DataFrame, order: str) -> DataFrame:
    """(page, rows, start_value, end_value): the table of contents of a paged export."""
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("start_value"), F.max(order).alias("end_value"))


def drill_down(df: DataFrame, levels: list[str], chosen: list) -> DataFrame:
    """The next level of a statistics tree: distinct values with counts below the chosen branch, or its rows at the end."""
    for column, v in zip(levels, chosen):
        df = df.filter(F.col(column) == v)
    if len(chosen) == len(levels):
        return df
    return df.groupBy(levels[len(chosen)]).agg(F.count(F.lit(1)).alias("count"))


def signature(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, rows) of each table: changes if any of them grew."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def anonymised(c: Column, secret: str) -> Column:
    """Addresses within a text column replaced alike everywhere, each octet keeping its number of digits."""

    def octets(ip: Column) -> Column:
        def other(part: Column, i: Column) -> Column:
            width = F.length(part)
            low = F.when(width == 1, 0).when(width == 2, 10).otherwise(100)
            span = F.when(width == 1, 10).when(width == 2, 90).otherwise(156)
            return (low + F.pmod(F.xxhash64(F.lit(secret), ip, i), span)).cast("string")

        return F.array_join(F.transform(F.split(ip, "[.]"), other), ".")

    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"), F.lit(1)))
    marked = F.aggregate(found, c, lambda acc, ip: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\d.\u0001])"), F.regexp_replace(ip, r"\.", r"\\."), F.lit(r"(?![\d.])")), F.concat(F.lit("\u0001"), octets(ip))))
    return F.regexp_replace(marked, "\u0001", "")
