"""Term frequencies against plain counting."""

import random
from collections import defaultdict

import pytest

from caseframe.llm import terms
from caseframe.plans.registry import load


def test_spelled():
    assert {terms.spelled(b) for b in (b"Caf\xc3\xa9", b"caf\xe9 ", "café".encode("utf-16-le"), "﻿CAFÉ".encode("utf-16-be"), b"\xef\xbb\xbfcaf\xc3\xa9\r\n", b" caf\xc3\xa9\0")} == {"café"}
    assert terms.spelled(None) is terms.spelled(b"") is terms.spelled(b" \0\r\n") is None
    assert terms.spelled(b"a") == "a" and terms.spelled(rb"\d{4}") == r"\d{4}"


def counted(hits, words, stats):
    spelled = {}
    for i, w in words:
        if i is not None and (t := terms.spelled(w)) is not None:
            spelled[i] = min(spelled.get(i, t), t)
    recorded = {}
    for i, n in stats:
        if i is not None:
            recorded.setdefault(i, []).append(n)
    by = {t: [0, set(), 0, 0] for t in spelled.values()}
    for i, t in spelled.items():
        by[t][2] += max((n for n in recorded.get(i, []) if n is not None), default=0)  # a counter can be negative
        by[t][3] += 1
    for h in set(hits):
        if h[1] in spelled:
            by[spelled[h[1]]][0] += 1
            by[spelled[h[1]]][1] |= {h[0]} - {None}
    return {t: (n, h, len(r), s) for t, (h, r, s, n) in by.items()}


def test_frequencies(spark):
    random.seed(2)
    words = [(1, b"the"), (2, b"THE "), (3, b"rare"), (4, None), (5, b"never"), (5, b"never"), (None, b"x"), (6, b" ")]
    hits = [(random.choice([None, 1, 2, 3, 4, 5, 6, 7]), random.choice([None, 1, 1, 1, 2, 4, 6, 99]), random.randrange(5), 3) for _ in range(300)] + [(1, 3, 0, 3)] * 2
    stats = [(1, 3), (2, None), (3, 1), (3, 1), (None, 5), (77, 1)]
    h = spark.createDataFrame(hits, "inode_id long, word_id int, offset long, n int")
    w = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "t") for i, x in words], "id int, word binary, term string")
    s = spark.createDataFrame([(*x, "c") for x in stats], "id int, hits int, counter string")
    freq = terms.frequencies(h, w, s)
    got = {r["term"]: (r["ids"], r["hits"], r["records"], r["recorded"]) for r in freq.collect()}
    assert got == counted(hits, words, stats)
    marked = {r["term"]: set(r["m"]) for r in freq.select("term", terms.marks(freq, terms.record_count(h)).alias("m")).collect()}
    assert marked["rare"] == {"rare"} and marked["never"] == {"rare"} and "common" in marked["the"] and "stale" in marked["the"]
    assert terms.frequencies(h.limit(0), w, s).filter("hits > 0").count() == 0
    assert terms.frequencies(h, w.limit(0), s).count() == 0


@pytest.mark.parametrize("table", ["logicalindexoffsets"])
def test_whole_table(spark, data, table):
    hits, words, stats = (load(spark, data, t) for t in (table, "dictionary", "logicalindexstats"))
    freq = terms.frequencies(hits.select("inode_id", "word_id", "offset", "length", "loaded"), words, stats)
    plain = counted([tuple(r) for r in hits.select("inode_id", "word_id", "offset", "length", "loaded").collect()], [(r["id"], r["word"]) for r in words.collect()], [(r["id"], r["hits"]) for r in stats.collect()])
    assert {r["term"]: (r["ids"], r["hits"], r["records"], r["recorded"]) for r in freq.collect()} == plain
