"""The filter language: trees, operators by type, both compilers."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe import filterlang as L
from caseframe.functions import net, text

TYPES = {t.name: t for t in [C.BigIntegerType("n"), C.FloatType("x"), C.StringType("s"), C.TimestampType("t"), C.IPType("ip"), C.StateType("state", states={"Open": "o", "Shut": "s"})]}
ROWS = [
    (1, 0.5, "Alpha beta", datetime.datetime(2024, 1, 2, 3, 4, 5), 0x0A0A0A01, "o"),
    (2, 1.5, "ALPHA", datetime.datetime(2023, 5, 6), 0x0A0A0AFF, "s"),
    (-3, 99.0, "100% _sure_", datetime.datetime(2024, 1, 2), 0x0A0A0B01, "o"),
    (None, None, None, None, None, None),
    (7, 2.0, "", datetime.datetime(1999, 12, 31), 0, "s"),
]
SCHEMA = "n long, x double, s string, t timestamp_ntz, ip long, state string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_trees():
    assert L.parse("") is None
    assert L.parse("a = 1 or b = 2 and c = 3") == L.Either(L.Test("a", "=", "1"), L.Both(L.Test("b", "=", "2"), L.Test("c", "=", "3")))
    assert L.parse("a = 1 or b = 2 and c = 3", precedence=False) == L.Both(L.Either(L.Test("a", "=", "1"), L.Test("b", "=", "2")), L.Test("c", "=", "3"))
    assert L.parse("(a = 1 OR b = 2) And c = 3") == L.Both(L.Either(L.Test("a", "=", "1"), L.Test("b", "=", "2")), L.Test("c", "=", "3"))
    assert L.parse("\"a col\" contains 'it\\'s \\x41'") == L.Test("a col", "contains", "it's A")
    assert L.columns_of(L.parse("a = 1 and (b = 2 or a > 3)")) == ["a", "b"]


@pytest.mark.parametrize("bad", ["a =", "a = 1 b", "(a = 1", "a = 1)", "and", 'a = "1', "a = 1 or", "a = 1 AND b = 2 OR"])
def test_unreadable(bad):
    with pytest.raises(L.FilterError):
        L.parse(bad)


# (text, numbers n of the rows that pass)
CASES = [
    ("n = 1", {1}), ("n != 1", {2, -3, 7}), ("n >= 2", {2, 7}), ("n < 0x2", {1, -3}), ("x > 1.4 and x < 50", {2, 7}), ("s = alpha", {2}), ("s != ALPHA", {1, -3, 7}), ("s contains ALPHA", {1, 2}),
    ("s contains '% _'", {-3}), ("s matches 'alpha%'", {1, 2}), ("s matches '%b_ta'", {1}), ("s regex 'a.*a$'", {1, 2}), ("t after 2023-12-31", {1, -3}), ("t before '2 Jan 2024'", {2, 7}), ("t after '2 Jan 2024'", {1}),
    ("t = 2024-01-02", {-3}), ("ip = 10.10.10.1", {1}), ("ip netmask 10.10.10.1/24", {1, 2}), ("ip netmask 10.10.10.2/24", {2}), ("ip matches 10.10", {1, 2, -3}), ("ip netmask 10.10.10.0", {1, 2}), ("ip > 10.10.10.200", {2, -3}),
    ("state is OPEN", {1, -3}), ("state = s", {2, 7}), ("n = 1 or n = 2 and x > 50", {1}),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_both_compilers(case, rows):
    tree = L.parse(case[0])
    assert {r["n"] for r in rows.filter(L.to_column(tree, TYPES)).collect()} == case[1]
    keep = L.to_function(tree, TYPES)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    assert {r[0] for r in ROWS if keep(dict(zip(names, r)))} == case[1]


@pytest.mark.parametrize("bad", ["n = x", "n contains 1", "x = y", "t after soon", "ip = 10.10.10.0/24", "ip = 10.10.10.0", "ip netmask 300.1.1.1", "state is ajar", "s regex '['", "nothing = 1", "n like 1"])
def test_refused(bad):
    with pytest.raises(L.FilterError):
        L.to_column(L.parse(bad), TYPES)


def test_unknown_column_may_pass(rows):
    assert rows.filter(L.to_column(L.parse("nothing = 1"), TYPES, unknown="true")).count() == len(ROWS)


def test_operators_are_listed():
    names = C.registry()
    assert {"=", "!=", "contains", "matches", "regex"} <= set(names["StringType"])
    assert {"netmask", "matches", "<"} <= set(names["IPType"])
    assert "is" in names["DeletedType"] and "has_magic" in names["InodeIDType"]


def test_added_operator(rows):
    @C.operator(C.BigIntegerType, "even")
    def even(c, a):
        return (c.expr % 2 == 0) == (a == "yes")

    assert {r["n"] for r in rows.filter(L.to_column(L.parse("n even yes"), TYPES)).collect()} == {2}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 32))
def test_cidr(number, bits):
    quad = ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    low, high = net.parse_cidr(f"{quad}/{bits}")
    assert low == number and high == number | (1 << 32 - bits) - 1


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("256.1.1.1",), ("1.2.3",), ("",), (None,)], "a string")
    got = [r[0] for r in df.select(net.ip_to_long(F.col("a"))).collect()]
    assert got == [0x01020304, 0xFFFFFFFF, None, None, None, None]


def test_globs():
    import re

    assert re.match(text.glob_regex("/a/*.txt"), "/a/x.txt") and not re.match(text.glob_regex("/a/*.txt"), "/a/b/x.txt")
    assert re.match(text.glob_regex("[!x]?"), "ab") and not re.match(text.glob_regex("[!x]?"), "xb")
