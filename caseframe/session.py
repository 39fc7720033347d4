"""Session helpers: table loading and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a folder of them)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoint().

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine,
    a temporary folder is used.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseframe-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


class Stages:
    """Tables of one schema, written one after the other in the checkpoint folder to cut lineage: a lost executor costs no more
    than the work since the last one. They are compressed and have statistics for the planner."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        self.schema, self.seen = None, {}

    def write(self, df: DataFrame, **observed: Column) -> DataFrame:
        """The table as written; ``seen`` then holds aggregates that were observed while it was."""
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        self.schema = df.schema
        if observed:
            watch = Observation()
            df.observe(watch, *[c.alias(k) for k, c in observed.items()]).write.parquet(self.paths[-1])
            self.seen = watch.get
        else:
            df.write.parquet(self.paths[-1])
        return self.read(len(self.paths) - 1)

    def read(self, first: int = 0, last: int | None = None) -> DataFrame:
        """The tables from ``first`` up to, not including, ``last`` as one scan."""
        return self.spark.read.schema(self.schema).parquet(*self.paths[first:last])
