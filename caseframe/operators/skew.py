"""Joins and keys under skew.

A key that holds a large share of the rows may not decide how long a task runs. At most ``limit`` keys can each hold
1/limit of the rows, so the list of hot keys is bounded whatever the size of the data; and no key that isn't on it holds more
than ``rows / limit``. How many keys are asked for, and over how many salts each is spread, follows from the number of rows and
from how many of them one task may hold.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

TASK_ROWS = 1_000_000  # rows of one key that one task may hold
MOST_KEYS = 10_000
MOST_SALTS = 4_096


def hot_keys(df: DataFrame, key: str, least: int | None = None, rows: int | None = None) -> dict:
    """Keys of more than ``least`` rows (``TASK_ROWS`` if not given) with the number of salts that brings each down to ``least``. Null is no key.

    There can be ``rows / least`` of them at most. Where that is more than ``MOST_KEYS``, the list is cut at rows / MOST_KEYS
    instead, so that it stays bounded. Counts are partial aggregates, so a hot key costs one row per map task; a table
    that is known to be small (``rows``) isn't looked at.
    """
    least = TASK_ROWS if least is None else least
    if rows is not None and rows <= least:
        return {}
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") > least).orderBy(F.desc("n"), key).limit(MOST_KEYS).collect()
    return {r[0]: min(MOST_SALTS, ceil(r["n"] / least)) for r in top}


def _literal(value: object, kind: DataType) -> Column:
    """A key as it was collected; a struct comes as a Row, which lit() doesn't know."""
    if isinstance(value, Row):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def _salts(df: DataFrame, key: str, hot: dict) -> Column:
    """The number of salts of a key, null on keys that aren't hot."""
    by: dict[int, list] = {}
    kind = df.schema[key].dataType
    for k, n in hot.items():
        by.setdefault(n, []).append(_literal(k, kind) if isinstance(k, Row) else k)
    out = F.lit(None).cast("int")
    for n, ks in sorted(by.items()):
        out = F.when(F.col(key).isin(ks), n).otherwise(out)
    return out


def salted(df: DataFrame, key: str, hot: dict, by: Column) -> DataFrame:
    """Adds ``_salt``: spread by the hash of ``by`` on hot keys, 0 on the others."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    return df.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), _salts(df, key, hot)).cast("int"), F.lit(0)))


def replicated(df: DataFrame, key: str, hot: dict) -> DataFrame:
    """The other side of :func:`salted`: rows of hot keys once for each salt."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(_salts(df, key, hot), F.lit(1)) - 1)))


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, by: Column, how: str = "left", hot: dict | None = None, least: int | None = None, rows: int | None = None) -> DataFrame:
    """Join ``facts`` to ``dim``, which has each key once, on ``key``; hot keys of ``facts`` are salted.

    Both sides name the key alike; other columns must differ. Null keys match nothing.
    """
    hot = hot_keys(facts, key, least, rows) if hot is None else hot
    joined = salted(facts, key, hot, by).join(replicated(dim, key, hot), [key, "_salt"], how)
    return joined.drop("_salt")
