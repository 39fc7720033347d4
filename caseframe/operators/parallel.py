"""Work for Python workers spread over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def worker_partitions(df: DataFrame) -> int:
    """Partitions for Python work: those of a shuffle, and at least two for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, spread evenly over two for each core; any other table as it is.

    Reading bytes or texts in Python takes far longer than moving them, and a small file is one partition. A large table has
    partitions enough and isn't shuffled; a table that comes out of a shuffle is left to adaptive execution.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.nodeName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
