"""References to records that do not exist, from signed counts that are maintained per key.

Every change of a referring or of a target row is a delta: +1 or -1 to a key's references or to its existence, at the time of
the row. :func:`merged` adds deltas to a state of summed counts per (tbl, key, time), one row each; rows whose counts
have come to nothing leave it. Counts add up in any order, so a state fed in batches, with rows that arrive late or are deleted,
equals one fed at once. The report is read from the state: keys with references while no existence is positive, now or at the time
of the reference. (A purge explains an absence; it makes none. The deletion of a target row is a delta of -1.)

Deltas are summed in each task before they are moved, times spread a hot key over all tasks, and existence, one row per key, is joined
with salted hot keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.operators import skew
from caseframe.session import Stages

ALWAYS = "0001-01-01 00:00:00"


@dataclass(frozen=True)
class Reference:
    """``source``.``column`` refers to ``target``.``key``; ``since`` is false where the target has no time of arrival."""

    name: str
    source: DataFrame
    column: str
    target: DataFrame
    target_name: str
    key: str
    since: bool = True


def _arrivals(ref: Reference, time: str) -> DataFrame:
    """(ref_id, at) of each target row that has a key; without a time it exists always."""
    always = F.lit(ALWAYS).cast("timestamp")
    at = F.coalesce(F.col(time).cast("timestamp"), always) if ref.since else always
    return ref.target.filter(F.col(ref.key).isNotNull()).select(F.col(ref.key).cast("long").alias("ref_id"), at.alias("at"))


STATE = "tbl string, ref_id long, at timestamp, refs long, exist long"


def deltas(ref: Reference, sources: DataFrame | None = None, targets: DataFrame | None = None, sign: int = 1, time: str = "loaded") -> DataFrame:
    """Deltas (:data:`STATE`) of referring rows and target rows that arrive (``sign`` 1) or are deleted (-1); those of the
    whole tables of ``ref`` if neither is given.

    Null keys are no references. A null time of a referring row is before all others; a target row without a time exists
    always.
    """
    if sources is None and targets is None:
        sources, targets = ref.source, ref.target
    out, n, none = [], F.lit(sign).cast("long"), F.lit(0).cast("long")
    if sources is not None:
        out.append(sources.filter(F.col(ref.column).isNotNull()).select(F.lit(ref.name).alias("tbl"), F.col(ref.column).cast("long").alias("ref_id"), F.col(time).cast("timestamp").alias("at"), n.alias("refs"), none.alias("exist")))
    if targets is not None:
        out.append(_arrivals(Reference(ref.name, ref.source, ref.column, targets, ref.target_name, ref.key, ref.since), time).select(F.lit(ref.name).alias("tbl"), "ref_id", "at", none.alias("refs"), n.alias("exist")))
    return reduce(DataFrame.unionByName, out)


def merged(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The state with deltas added to it."""
    both = changes if state is None else state.unionByName(changes)
    return both.groupBy("tbl", "ref_id", "at").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).filter("refs != 0 or exist != 0")


class Maintained:
    """A state kept as a table in a folder, for batches or ``foreachBatch`` of a stream: each batch writes the next version,
    after which the one before is deleted. A batch number that was applied before changes nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs, self.path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The last batch that was written whole; -1 if there is none."""
        if not self.fs.exists(self.path(self.folder)):
            return -1
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(self.folder))]
        return max((int(n[1:]) for n in names if n[0] == "v" and self.fs.exists(self.path(f"{self.folder}/{n}/_SUCCESS"))), default=-1)

    def state(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], STATE) if v < 0 else self.spark.read.schema(STATE).parquet(f"{self.folder}/v{v}")

    def apply(self, changes: DataFrame, batch: int | None = None) -> None:
        last = self.version()
        batch = last + 1 if batch is None else batch
        if batch <= last:
            return
        merged(self.state(), changes).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        if last >= 0:
            self.fs.delete(self.path(f"{self.folder}/v{last}"), True)


def report(state: DataFrame, period: Callable[[Column], Column]) -> DataFrame:
    """tbl, ref_id, period, refs, first_ref, state of each key and period with at least one orphan reference.

    state is ``absent`` (no existence) or ``later`` (it began after a referring row). refs counts all of the period's
    references to the key, also those that aren't orphans (:func:`orphan_references` counts these); ``period`` maps their time to a text.
    """
    born = state.filter("exist > 0").groupBy("tbl", "ref_id").agg(F.min("at").alias("born")).select(F.struct("tbl", "ref_id").alias("key"), "born")
    refs = state.filter("refs > 0").select(F.struct("tbl", "ref_id").alias("key"), "at", "refs")
    seen = skew.lookup_join(refs, born, "key", F.col("at"))
    late = F.col("at").isNull() & (F.col("born") > F.lit(ALWAYS).cast("timestamp")) | (F.col("at") < F.col("born"))
    orphan = F.col("born").isNull() | F.coalesce(late, F.lit(False))
    sums = seen.groupBy("key", period(F.col("at")).alias("period")).agg(F.sum("refs").alias("refs"), F.min("at").alias("first_ref"), F.max(F.col("born").isNull()).alias("absent"), F.max(orphan).alias("orphan"))
    return sums.filter("orphan").select("key.tbl", "key.ref_id", "period", "refs", "first_ref", F.when(F.col("absent"), "absent").otherwise("later").alias("state"))


def orphans(refs: list[Reference], period: Callable[[Column], Column], time: str = "loaded") -> DataFrame:
    """tbl, target, ref_id, period, refs, first_ref, state: the :func:`report` of a state that holds the whole tables and is written
    once."""
    changes = reduce(DataFrame.unionByName, [deltas(r, time=time) for r in refs])
    names = F.create_map(*[F.lit(x) for r in refs for x in (r.name, r.target_name)])
    state = Stages(refs[0].source.sparkSession, "orphans").write(merged(None, changes))
    return report(state, period).select("tbl", names[F.col("tbl")].alias("target"), "ref_id", "period", "refs", "first_ref", "state")


def orphan_references(refs: list[Reference], period: Callable[[Column], Column], time: str = "loaded") -> DataFrame:
    """tbl, target, ref_id, period, orphan_refs, state: the same keys and periods as :func:`orphans`, with the references that are orphans.

    Each referring row is compared with the birth of its own key, and rows equal in all columns count once. Births have one
    row per key and hot keys of the references are salted. Source columns of a map type can't be compared.
    """
    every = None
    for r in refs:
        born = _arrivals(r, time).groupBy("ref_id").agg(F.min("at").alias("born"))
        rows = r.source.filter(F.col(r.column).isNotNull()).select(F.col(r.column).cast("long").alias("ref_id"), F.col(time).alias("at"), F.struct("*").alias("row"))
        seen = skew.lookup_join(rows, born, "ref_id", F.col("row"))
        at = F.col("at").cast("timestamp")
        orphan = seen.filter(F.col("born").isNull() | at.isNull() & (F.col("born") > F.lit(ALWAYS).cast("timestamp")) | (at < F.col("born")))
        state = F.when(F.col("born").isNull(), "absent").otherwise("later")
        once = orphan.select("ref_id", period(F.col("at")).alias("period"), state.alias("state"), "row").distinct()
        counts = once.groupBy("ref_id", "period", "state").agg(F.count(F.lit(1)).alias("orphan_refs"))
        counts = counts.select(F.lit(r.name).alias("tbl"), F.lit(r.target_name).alias("target"), "ref_id", "period", "orphan_refs", "state")
        every = counts if every is None else every.unionByName(counts)
    return every
