"""The table query: star join of the tables its columns need, filter, group count, order, page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe import filterlang
from caseframe.columns import ColumnType

PAGE = 50


@dataclass(frozen=True)
class QuerySpec:
    """columns are shown in order; ``filters`` are columns that only the filter text may name. ``order`` is the index of a
    shown column, descending unless ``ascending``; ``ties`` are columns that make the order total. ``group`` is the index of a
    column to count by."""

    columns: Sequence[ColumnType]
    text: str = ""
    filters: Sequence[ColumnType] = ()
    where: Column | None = None
    group: int | None = None
    order: int | None = 0
    ascending: bool = False
    ties: Sequence[str] = ()
    hidden: Sequence[int] = ()
    offset: int = 0
    limit: int | None = None
    unknown: str = "error"
    key: str = "inode_id"
    extra: Mapping = field(default_factory=dict)


def joined(spec: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The tables of all shown columns and of those the filter tests, joined to the first on the key. Rows without a partner
    are left out and one-to-many tables multiply rows, as an inner star join does."""
    tested = {n.lower() for n in filterlang.columns_of(filterlang.parse(spec.text))}
    used = [c.table for c in [*spec.columns, *(c for c in spec.filters if c.name.lower() in tested)] if c.table]
    names = list(dict.fromkeys(used)) or [next(iter(tables))]
    return reduce(lambda a, b: a.join(b, spec.key, "inner"), [tables[n] for n in names])


def conditions(spec: QuerySpec) -> Column:
    """Fixed condition, implied conditions of the shown columns and the filter text, all of which must hold."""
    types = {c.name: c for c in [*spec.columns, *spec.filters]}
    parts = [c.where() for c in spec.columns if c.where() is not None]
    if spec.where is not None:
        parts.append(spec.where)
    if (tree := filterlang.parse(spec.text)) is not None:
        parts.append(filterlang.to_column(tree, types, spec.unknown))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def unpaged(spec: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of the query, not ordered."""
    rows = joined(spec, tables).filter(conditions(spec))
    if spec.group is not None:
        c = spec.columns[spec.group]
        return rows.groupBy(c.select()).agg(F.count(F.lit(1)).alias("Count"))
    shown = [c.select() for i, c in enumerate(spec.columns) if i not in spec.hidden]
    order = [spec.columns[spec.order].order_by().alias("_order")] if spec.order is not None else []
    return rows.select(*shown, *order, *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(spec.ties)])


def run(spec: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The page of the query that ``offset`` and ``limit`` name; without a limit all rows. A page is a top-k, not a sort of
    everything: Spark keeps offset + limit rows per task."""
    rows = unpaged(spec, tables)
    if spec.group is not None:
        return rows
    ties = [f"_tie{i}" for i in range(len(spec.ties))]
    if spec.limit is not None and spec.order is not None:
        rows = rows.orderBy(F.col("_order").asc_nulls_first() if spec.ascending else F.col("_order").desc_nulls_last(), *ties)
        rows = (rows.offset(spec.offset) if spec.offset else rows).limit(spec.limit)
    return rows.drop("_order", *ties)


def count(spec: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The number of rows that match."""
    return joined(spec, tables).filter(conditions(spec)).agg(F.count(F.lit(1)).alias("total"))


def recent(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The newest rows by key."""
    return df.orderBy(F.col(key).desc()).limit(n)
