"""Reassembly without a Python call per session, of which large captures have millions."""

import pytest
from pyspark.sql import functions as F

from caseframe.operators import flows
from caseframe.plans import protocols, registry, scans  # noqa: F401

NATIVE = ["T10_destroyed", "T2_reassembled_bytes", "T6_lifecycle", "T2_reassembled", "T4_padded"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python(name, spark, data):
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_segments_without_number(spark):
    """They are reported and have no bytes, in any session; null keys are one key."""
    seg = [(1, 1, 1, None, b"ab"), (2, 1, 1, 5, b"cd"), (3, 1, 1, 8, b"e"), (4, None, None, None, None), (5, 1, 2, 0, b"x")]
    df = spark.createDataFrame([(i, s, n, q, None if b is None else bytearray(b)) for i, s, n, q, b in seg], "id long, stream long, session long, seq long, data binary")
    got = {(r["stream"], r["session"]): (bytes(r["content"]), r["events"], r["gaps"]) for r in flows.reassembled(df).collect()}
    assert got == {
        (1, 1): (b"cd\0e", ["2:est", "2:data", "3:gap", "3:data", "1:misc", "3:destroy"], []),
        (None, None): (b"", ["4:est", "4:misc", "4:destroy"], []),
        (1, 2): (b"x", ["5:est", "5:data", "5:destroy"], []),
    }


def test_many_sessions(spark):
    """Sessions of overlaps, repeats and gaps, each beside the others, in any order of arrival."""
    one = [(1, 100, b"abc"), (2, 106, b"ghi"), (3, 103, b"def"), (4, 101, b"XX"), (5, 107, b"HIJ"), (6, 112, b"mn"), (7, 114, b"")]
    rows = spark.createDataFrame([(i, s, bytearray(b)) for i, s, b in one], "id long, seq long, data binary").crossJoin(spark.range(2_000).select(F.col("id").alias("stream"))).withColumn("session", F.lit(1).cast("long"))
    got = flows.reassembled(rows.repartition(7)).groupBy(F.hex("content"), "events").count().collect()
    assert [(bytes.fromhex(r[0]), r[1], r[2]) for r in got] == [(b"abcdefghiJ\0\0mn", ["1:est", "1:data", "4:retran", "3:data", "2:data", "5:data", "6:gap", "6:data", "7:misc", "7:destroy"], 2_000)]
