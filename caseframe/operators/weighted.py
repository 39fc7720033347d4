"""Per-key results where a few keys hold most records, by value-frequency compression.

Records are first grouped by key and value, so that a hot key becomes one weighted row per distinct value, spread over
all tasks by the hash of both. Distinct counts, modes and percentiles per key then come from the weighted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.operators.skew import lookup_join


def compress(df: DataFrame, key: str, value: str, position: str | None = None) -> DataFrame:
    """One row (key, value, weight[, first, last]) for each distinct pair. Null keys are dropped, null values kept."""
    aggs = [F.count(F.lit(1)).alias("weight")]
    if position:
        aggs += [F.min(position).alias("first_pos"), F.max(position).alias("last_pos")]
    return df.filter(F.col(key).isNotNull()).groupBy(key, value).agg(*aggs)


def per_key(weighted: DataFrame, key: str, value: str) -> DataFrame:
    """key, hits, distinct_values, first_pos, last_pos, mode, mode_hits from rows of :func:`compress`.

    Null values count as hits but not as a distinct value or a mode. Ties of the mode go to the smallest value. All of it
    is an algebraic aggregate, combined before the shuffle, so a hot key costs one row per task.
    """
    known = F.col(value).isNotNull()
    best = F.max(F.when(known, F.struct(F.col("weight").alias("w"), (-F.col(value)).alias("v"))))
    out = weighted.groupBy(key).agg(
        F.sum("weight").alias("hits"),
        F.sum(known.cast("long")).alias("distinct_values"),
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
        best.alias("best"),
    )
    return out.select(key, "hits", "distinct_values", "first_pos", "last_pos", (-F.col("best.v")).alias("mode"), F.col("best.w").alias("mode_hits"))


def weighted_percentiles(weighted: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """Exact lower percentiles of ``value`` for each key from weighted rows: the least value whose running weight reaches
    the share of the key's total.

    The running sum of one key is itself split: values are cut into ranges (64 of the value's own width), range totals give
    each range its starting weight, and only within a range are the rows ordered, so no task holds a whole hot key.
    """
    rows = weighted.filter(F.col(value).isNotNull())
    limits = rows.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("weight").alias("_total"))
    cut = F.least(F.lit(63), F.floor((F.col(value) - F.col("_lo")) * 64.0 / (F.col("_hi") - F.col("_lo") + F.lit(1)))).cast("int")
    placed = lookup_join(rows, limits, key, F.col(value), "inner").withColumn("_range", cut)
    totals = placed.groupBy(key, "_range").agg(F.sum("weight").alias("_w"))
    before = totals.withColumn("_before", F.sum("_w").over(Window.partitionBy(key).orderBy("_range")) - F.col("_w"))
    within = Window.partitionBy(key, "_range").orderBy(value)
    ranked = placed.join(before.drop("_w"), [key, "_range"]).withColumn("_cum", F.sum("weight").over(within) + F.col("_before"))
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_cum") >= F.col("_total") * s, F.col(value))).alias(f"p{round(s * 100)}") for s in shares])


def heavy_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of ``df`` (rows with a null key are in the total, null is no key)."""
    total = df.count()
    counts = compress(df, key, value).groupBy(key).agg(F.sum("weight").alias("hits"))
    return counts.filter(F.col("hits") >= F.lit(share) * F.lit(total)).filter(F.lit(total) > 0)
