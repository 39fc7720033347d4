"""Filling containers of fixed capacity with items of varying length.

Pieces are dealt to partitions of bounded size and each is packed by best-fit decreasing. Dual feasible functions give a
lower bound for the number of bins a partition needs; where the two agree the partition is certified. Partitions with a gap
give up the pieces of their bins that are not full; these are pooled, dealt out anew to larger partitions and packed again.
A container kind keeps the new packing of its pool only if that has fewer bins in total, and goes on while it has, so the number of bins never rises. A piece is never split unless its document exceeds the capacity: then full containers are cut off it and the
rest is packed with the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.session import Stages

PARTITION_ITEMS = 5_000
POOL_ITEMS = 50_000
ROUNDS = 12
MAX_CONTAINERS = 200


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Bins are found by their free space: bit r of a mask is set while some bin has r free, so the
    tightest bin for a size is the lowest bit at or above it."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    free: dict[int, list[int]] = {}
    mask, used = 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = free[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            b, room, used = used, capacity, used + 1
        bins[i] = b
        rest = room - size
        stack = free.setdefault(rest, [])
        if not stack:
            mask |= 1 << rest
        stack.append(b)
    return bins


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from a histogram of sizes, as the best of two families of dual feasible functions.

    The first: for a threshold t up to half of the capacity, sizes above capacity - t count as the whole capacity, sizes
    below t as nothing. The second, for k: x -> floor((k + 1) x / C) / k unless (k + 1) x / C is whole.
    """
    keep = sizes > 0
    sizes, counts = sizes[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(sizes):
        return 0
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    mass, number = np.concatenate([[0], np.cumsum(sizes * counts)]), np.concatenate([[0], np.cumsum(counts)])
    ts = np.unique(np.concatenate([[0], sizes[sizes <= capacity // 2]]))
    low, high = np.searchsorted(sizes, ts, "left"), np.searchsorted(sizes, capacity - ts, "right")
    best = int(np.max(-(-((mass[high] - mass[low]) + capacity * (number[-1] - number[high])) // capacity)))
    for k in range(1, 9):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        total = int(np.sum(np.where(whole, k * sizes, capacity * (scaled // capacity)) * counts))
        best = max(best, -(-total // (k * capacity)))
    return best


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable")
    sizes, capacity = rows["size"].to_numpy(), int(rows["capacity"].iloc[0])
    bins = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    n = len(fill)
    bound = lower_bound(sizes, np.ones(len(sizes), dtype=np.int64), capacity)
    return rows.assign(bin=bins, fill=fill[bins], gap=n - max(bound, 1))


_ITEM = "container string, capacity long, doc_id long, part long, size long, grp long"


def pieces(sized: DataFrame, containers: DataFrame) -> tuple[DataFrame, list]:
    """(container, capacity, doc_id, part, size, whole) of every document for every container; whole pieces fill one.

    The container kinds are literals of the plan, ``MAX_CONTAINERS`` at most. Kinds without a positive capacity are left
    out; of repeated names the smallest capacity holds.
    """
    kinds = containers.filter((F.col("capacity") > 0) & F.col("container").isNotNull()).groupBy("container").agg(F.min("capacity").cast("long").alias("capacity")).orderBy("container").limit(MAX_CONTAINERS + 1).collect()
    if len(kinds) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} kinds of containers")
    if not kinds:
        kinds = [("", 1)]
        sized = sized.limit(0)
    kind = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(int(k)).cast("long").alias("capacity")) for c, k in kinds]))
    rows = sized.select("doc_id", "tokens", kind.alias("k")).select("k.container", "k.capacity", "doc_id", "tokens")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("long")
    rest = F.col("tokens") - full * F.col("capacity")
    last = F.when((rest > 0) | (full == 0), F.array(full)).otherwise(F.array().cast("array<bigint>"))
    part = F.concat(F.when(full > 0, F.sequence(F.lit(0).cast("long"), full - 1)).otherwise(F.array().cast("array<bigint>")), last)
    out = rows.withColumn("part", F.explode(part))
    return out.select("container", "capacity", "doc_id", "part", F.when(F.col("part") < full, F.col("capacity")).otherwise(rest).alias("size"), (F.col("part") < full).alias("whole")), kinds


def _is_open() -> Column:
    """In a bin that isn't full, of a partition that isn't certified."""
    return (F.col("gap") > 0) & (F.col("fill") < F.col("capacity"))


def _bins(packed: DataFrame) -> dict[str, tuple[int, int, int, int]]:
    """(bins, open bins of partitions with a gap, their partitions, their pieces) of each container kind."""
    each = packed.groupBy("container", "grp", "bin").agg(F.count(F.lit(1)).alias("n"), F.max(_is_open()).alias("open"))
    rows = each.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.count_if("open").alias("open"), F.count_distinct(F.when(F.col("open"), F.col("grp"))).alias("groups"), F.sum(F.when(F.col("open"), F.col("n"))).alias("items"))
    return {r["container"]: (r["bins"], r["open"], r["groups"], r["items"] or 0) for r in rows.collect()}


def pack(sized: DataFrame, containers: DataFrame, items: int = PARTITION_ITEMS, pool_items: int = POOL_ITEMS, rounds: int = ROUNDS, log: list | None = None) -> DataFrame:
    """container, capacity, doc_id, part, tokens, bin, fill of every piece of every document.

    sized: doc_id (unique), tokens; null tokens count as 0. An empty document lies in some container too. bin is a text,
    unique within a container kind. ``items`` and ``pool_items`` bound what one task holds at first and in an exchange. A kind is done when
    all its partitions are certified, when one partition holds its pool, when an exchange saves no bin, or after ``rounds``.
    ``log`` is given (round, container, bins before, bins after) of every exchange.
    """
    cut, kinds = pieces(sized.select("doc_id", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens")), containers)
    cut = Stages(sized.sparkSession, "pieces").write(cut)
    loose = cut.filter(~F.col("whole"))
    most = max([r["n"] for r in loose.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
    whole = cut.filter("whole").select("container", "capacity", "doc_id", "part", F.col("size").alias("tokens"), F.concat(F.lit("w"), F.col("doc_id"), F.lit("."), F.col("part")).alias("bin"), F.col("capacity").alias("fill"))
    out, stages = [whole], Stages(sized.sparkSession, "packing")

    def packed(rows: DataFrame, n: int, most: int, r: int) -> DataFrame:
        """Pieces dealt to groups of ``n`` at most on average, and packed."""
        groups = max(1, -(-most // n))
        dealt = rows.select("container", "capacity", "doc_id", "part", "size", F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(groups)).alias("grp"))
        return stages.write(dealt.groupBy("container", "grp").applyInPandas(_pack, _ITEM + ", bin long, fill long, gap long"))

    def keep(rows: DataFrame, r: int) -> None:
        out.append(rows.select("container", "capacity", "doc_id", "part", F.col("size").alias("tokens"), F.concat_ws(".", F.lit(f"r{r}"), "grp", "bin").alias("bin"), "fill"))

    now, r = packed(loose, items, most, 0), 0
    state = _bins(now)
    active = [c for c, (_, _, groups, _) in state.items() if groups > 1]
    while active and r < rounds:
        is_open = _is_open() & F.col("container").isin(active)
        pool = now.filter(is_open)
        keep(now.filter(~is_open), r)
        r += 1
        trial = packed(pool, pool_items, max(state[c][3] for c in active), r)
        after = _bins(trial)
        better = [c for c in active if after[c][0] < state[c][1]]
        if log is not None:
            log += [(r, c, state[c][1], after[c][0]) for c in active]
        keep(pool.filter(~F.col("container").isin(better)), r - 1)
        now, state = trial.filter(F.col("container").isin(better)), after
        active = [c for c in better if after[c][2] > 1]
    keep(now, r)
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def certificate(packed: DataFrame) -> DataFrame:
    """container, capacity, documents, tokens, bins, bound (bins that any packing needs), fill of a result of :func:`pack`.

    The bound comes from a histogram of sizes, at most capacity + 1 rows per kind.
    """
    histogram = packed.groupBy("container", "capacity", "tokens").agg(F.count(F.lit(1)).alias("n"))

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        need = lower_bound(rows["tokens"].to_numpy(), rows["n"].to_numpy(), capacity)
        return pd.DataFrame({"container": [rows["container"].iloc[0]], "bound": [max(need, 1)]})

    bounds = histogram.groupBy("container").applyInPandas(bound, "container string, bound long")
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("part") == 0).cast("long")).alias("documents"))
    total = bins.groupBy("container", "capacity").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("bins"))
    return total.join(bounds, "container").withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))


def properties(packed: DataFrame, sized: DataFrame, containers: DataFrame) -> DataFrame:
    """container, documents (that lie in it whole or in all their parts), overfull (bins above the capacity), split (documents that
    were split but would have fitted), misstated (bins whose fill isn't the sum of their pieces)."""
    kinds = containers.filter((F.col("capacity") > 0) & F.col("container").isNotNull()).groupBy("container").agg(F.min("capacity").cast("long").alias("capacity"))
    docs = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("part").alias("different"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    docs = docs.join(sized.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("true")), "doc_id")
    per_doc = docs.groupBy("container").agg(F.count_if((F.col("tokens") == F.col("true")) & (F.col("parts") == F.col("different"))).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split"))
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"), F.max("fill").alias("fill"), F.min("fill").alias("least"))
    per_bin = bins.groupBy("container").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), F.count_if((F.col("tokens") != F.col("fill")) | (F.col("fill") != F.col("least"))).alias("misstated"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return kinds.join(per_doc, "container", "left").join(per_bin, "container", "left").select("container", *[zero(c) for c in ("documents", "overfull", "split", "misstated")])
