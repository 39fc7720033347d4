"""Frequency of every distinct term over the whole collection, and marks for terms too rare or too common to be useful.

Equal hits count once. Hits become (word, record) counts, combined in each task before anything is shuffled, so neither a
hot word nor a hot record is gathered anywhere. The dictionary joins these counts, not the hits; its hot words are salted.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caseframe.operators.skew import lookup_join

# Byte order marks.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
PADDING = " \t\r\n\v\f\0 "


def spelled(raw: bytes | None) -> str | None:
    """The text that the bytes of a dictionary word spell, in lower case and without padding; null and blank are null.

    UTF-16 is told by a mark or by zero bytes at every other place, else UTF-8, else Windows-1252 (bytes it lacks as
    Latin-1).
    """
    if raw is None:
        return None
    raw = bytes(raw)
    for mark, name in MARKS:
        if raw.startswith(mark):
            text = raw[len(mark) :].decode(name, "replace")
            break
    else:
        half = len(raw) // 2
        low, high = raw[0 : 2 * half : 2].count(0), raw[1 : 2 * half : 2].count(0)
        if len(raw) % 2 == 0 and half > 1 and high * 2 > half > low * 2:
            text = raw.decode("utf-16-le", "replace")
        elif len(raw) % 2 == 0 and half > 1 and low * 2 > half > high * 2:
            text = raw.decode("utf-16-be", "replace")
        else:
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                try:
                    text = raw.decode("cp1252")
                except UnicodeDecodeError:
                    text = raw.decode("latin-1")
    return text.strip(PADDING).lower().strip(PADDING) or None


@F.pandas_udf(StringType())
def _spelled(words: pd.Series) -> pd.Series:
    return words.map(spelled)


def terms_of(dictionary: DataFrame) -> DataFrame:
    """(word_id, term), each id once; the smallest term if rows of one id spell several. Null ids or words are dropped."""
    rows = dictionary.filter(F.col("id").isNotNull() & F.col("word").isNotNull()).select(F.col("id").cast("long").alias("word_id"), _spelled("word").alias("term"))
    return rows.filter(F.col("term").isNotNull()).groupBy("word_id").agg(F.min("term").alias("term"))


def frequencies(hits: DataFrame, dictionary: DataFrame, stats: DataFrame) -> DataFrame:
    """term, ids, hits, records, recorded for every term of the dictionary; a term without hits has 0.

    hits needs word_id, inode_id; rows equal in all columns are one hit; a null word_id is no hit of a term, a null inode_id
    no record. recorded is the sum of the counters of the term's ids, a missing or null one as 0 (of repeated counters of an
    id the largest).
    """
    each = hits.filter(F.col("word_id").isNotNull()).distinct()
    pairs = each.groupBy(F.col("word_id").cast("long").alias("word_id"), "inode_id").agg(F.count(F.lit(1)).alias("n"))
    words = terms_of(dictionary)
    named = lookup_join(pairs, words, "word_id", F.col("inode_id"), "inner")
    records = named.groupBy("term", "inode_id").agg(F.sum("n").alias("n"))
    counted = records.groupBy("term").agg(F.sum("n").alias("hits"), F.count("inode_id").alias("records"))
    counters = stats.filter(F.col("id").isNotNull()).groupBy(F.col("id").cast("long").alias("word_id")).agg(F.max("hits").cast("long").alias("counter"))
    known = words.join(counters, "word_id", "left").groupBy("term").agg(F.count(F.lit(1)).alias("ids"), F.sum(F.coalesce("counter", F.lit(0))).alias("recorded"))
    return known.join(counted, "term", "left").select("term", "ids", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("records", F.lit(0)).alias("records"), "recorded")


def marks(freq: DataFrame, all_records: int, fewest: int = 3, share: float = 0.2) -> Column:
    """The marks of a row of :func:`frequencies` as an array: rare, common, stale."""
    return F.array_compact(
        F.array(
            F.when(freq["records"] < fewest, F.lit("rare")),
            F.when(freq["records"] > share * all_records, F.lit("common")),
            F.when(freq["recorded"] != freq["hits"], F.lit("stale")),
        )
    )


def record_count(hits: DataFrame) -> int:
    """Distinct records of the whole collection; combined by hash, one number reaches the driver."""
    return hits.filter(F.col("inode_id").isNotNull()).select("inode_id").distinct().count()
