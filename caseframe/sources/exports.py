"""Exports and changes of stored tables. Without a table format that changes rows in place, a change is a new version."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.columns import ColumnType


def csv_columns(df: DataFrame, columns: list[ColumnType]) -> DataFrame:
    """Each column as its type writes it."""
    return df.select(*[c.csv().alias(c.name) for c in columns])


def write_csv(df: DataFrame, folder: str, start: int | None = None, end: int | None = None, order: str | None = None) -> None:
    """CSV with a header; rows ``start`` to ``end`` of an order if given, else all without a sort."""
    if order is not None:
        df = df.orderBy(order)
        df = df.offset(start or 0)
        if end is not None:
            df = df.limit(end - (start or 0))
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(folder)


def csv_round_trip(df: DataFrame) -> DataFrame:
    """Written and read again: what an export holds. The folder lies beside the checkpoints, which all executors share."""
    from caseframe.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(df.sparkSession)
    folder = f"{base}/{uuid.uuid4().hex}.csv"
    write_csv(df, folder)
    return df.sparkSession.read.option("header", "true").option("escape", '"').csv(folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """A paged export: a folder per page."""
    pages.write.mode("overwrite").partitionBy("page").json(folder)


def without_duplicates(df: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """One row per key, that with the smallest ``keep``; other columns go with it."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(F.col(keep).isNull(), F.col(keep)))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def inserted(df: DataFrame, **values) -> DataFrame:
    """With one more row; columns that aren't given are null."""
    row = df.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(row)


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which ``where`` isn't true."""
    return df.filter(~F.coalesce(where, F.lit(False)))
