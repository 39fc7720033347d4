"""Running numbers within keys, without gathering a key in one task.

The order column is cut into ranges of about equally many rows, whatever their spread: approximate quantiles of the whole table,
as many as bring a range down to ``TASK_ROWS``. Totals per key and range, one row each, give each range what came before it;
only within one range of one key are rows ordered. So a key that holds most rows, or a table without a key, is still spread. (Rows
of one key with the same order value stay together: their order is that of ``ties``.)
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.operators import skew

LEAST_RANGES, MOST_RANGES = 16, 10_000


def _cuts(work: DataFrame, ranges: int | None) -> list[float]:
    """Upper ends of all ranges but the last. One pass: a sketch of the quantiles, thinned to the number of ranges."""
    steps = MOST_RANGES if ranges is None else ranges
    if steps < 2:
        return []
    # One text as a literal: thousands of them would take the planner longer than the data.
    shares = F.split(F.lit(",".join(str(i / steps) for i in range(1, steps))), ",").cast("array<double>")
    quantiles = F.percentile_approx("_o", shares, 10 * steps)
    rows, got = work.agg(F.count("_o"), quantiles).first()
    if not rows:
        return []
    wanted = steps if ranges is not None else min(MOST_RANGES, max(LEAST_RANGES, ceil(rows / skew.TASK_ROWS)))
    each = max(1, steps // wanted)
    return sorted(set(got[each - 1 :: each]))


def running(df: DataFrame, key: str | None, order: str, numbers: dict[str, tuple[str, Column]], ranges: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds a column per entry of ``numbers``: name to (kind, value). Kinds: ``count`` and ``sum`` with the row itself, ``max``
    and ``before`` (the maximum of earlier rows only, null for a key's first). Order is by ``order``, a number or a time, and
    then ``ties``; rows with a null order come first. Null keys are one key. Without a key the whole table is ordered.
    """
    work = df.withColumn("_key", F.lit(0) if key is None else F.col(key)).withColumn("_o", F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order].startswith("timestamp") else F.col(order).cast("double"))
    cuts = _cuts(work, ranges)
    if cuts:
        # Bucketizer finds the range by binary search; its ranges hold their lower end, and nulls are in one after the last.
        ends = [float("-inf"), *cuts, float("inf")]
        work = Bucketizer(splits=ends, inputCol="_o", outputCol="_range", handleInvalid="keep").transform(work)
        work = work.withColumn("_range", F.when(F.col("_o").isNull(), -1).otherwise(F.col("_range").cast("int")))
    else:
        work = work.withColumn("_range", F.lit(0))
    work = work.withColumns({f"_v{i}": v for i, (_, v) in enumerate(numbers.values())})
    totals = work.groupBy("_key", "_range").agg(*[(F.count(F.lit(1)) if k == "count" else F.sum(f"_v{i}") if k == "sum" else F.max(f"_v{i}")).alias(f"_t{i}") for i, (k, _) in enumerate(numbers.values())])
    w = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_key", "_range", *[(F.sum(f"_t{i}") if k in ("count", "sum") else F.max(f"_t{i}")).over(w).alias(f"_c{i}") for i, (k, _) in enumerate(numbers.values())])
    inside = Window.partitionBy("_key", "_range").orderBy(F.col(order).asc_nulls_first(), *ties)
    so_far, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for i, (name, (k, _)) in enumerate(numbers.items()):
        carry = F.col(f"_c{i}")
        if k == "count":
            out[name] = F.row_number().over(inside) + F.coalesce(carry, F.lit(0))
        elif k == "sum":
            out[name] = F.coalesce(F.sum(f"_v{i}").over(so_far), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif k == "max":
            out[name] = F.greatest(F.max(f"_v{i}").over(so_far), carry)
        else:
            out[name] = F.greatest(F.max(f"_v{i}").over(earlier), carry)
    joined = work.join(carried.withColumnRenamed("_key", "_k2").withColumnRenamed("_range", "_r2"), F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_range") == F.col("_r2")))
    return joined.withColumns(out).select(*df.columns, *out)
