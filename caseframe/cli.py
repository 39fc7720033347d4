"""Command line: export columns of a stored table through a filter."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caseframe import columns as C
from caseframe import query as Q
from caseframe.sources import exports


def column_types(df: DataFrame, ips: tuple[str, ...] = ()) -> list[C.ColumnType]:
    """Column types that fit a table's schema; addresses, which are stored as numbers, are named."""
    kinds = {T.LongType: C.BigIntegerType, T.IntegerType: C.IntegerType, T.ShortType: C.IntegerType, T.DoubleType: C.FloatType, T.FloatType: C.FloatType, T.TimestampType: C.TimestampType, T.TimestampNTZType: C.TimestampType}
    return [C.IPType(f.name) if f.name in ips else kinds.get(type(f.dataType), C.StringType)(f.name) for f in df.schema.fields]


def export(df: DataFrame, names: list[str], text: str, folder: str, ips: tuple[str, ...] = ()) -> None:
    types = {c.name: c for c in column_types(df, ips)}
    spec = Q.QuerySpec([types[n] for n in names] if names else list(types.values()), text, list(types.values()), order=None)
    exports.write_csv(Q.run(spec, {"t": df}), folder)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="caseframe", description=__doc__)
    p.add_argument("table", help="a Parquet file or folder")
    p.add_argument("folder", help="where the CSV goes")
    p.add_argument("--columns", nargs="*", default=[])
    p.add_argument("--filter", default="")
    p.add_argument("--ip", nargs="*", default=[], help="columns that hold addresses as numbers")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("caseframe").getOrCreate()
    export(spark.read.parquet(a.table), a.columns, a.filter, a.folder, tuple(a.ip))


if __name__ == "__main__":
    main()
