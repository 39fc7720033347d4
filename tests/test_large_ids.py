"""Queries over ids greater than those of the small tables, against their SQL."""

import datetime as dt
import ipaddress

import pytest

from caseframe.plans import joins, readers, registry, scalars, scans  # noqa: F401
from compare import connect, spark_rows, sql_rows


def _same(spark, folder, name):
    got = spark_rows(registry.QUERIES[name](spark, folder))
    assert got == sql_rows(connect(folder), registry.SQL[name])
    return got


def test_registry_records(spark, tmp_path):
    keys = [0, 255, 256, 65535, 65536, 150_000, 20_000_000]
    spark.createDataFrame([(k, k % 25, "BUILDING") for k in keys], "c_custkey int, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    assert len(_same(spark, str(tmp_path), "S19_registry_records")[1]) == len(keys)


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    """Folder of events of users whose ids need one to three octets."""
    folder = str(tmp_path_factory.mktemp("users"))
    rows = [(i, dt.datetime(2024, 1, 1 + i), u, kind, i + 0.5) for i, (u, kind) in enumerate((u, k) for u in (0, 59, 60, 255, 256, 1499, 70_000) for k in ("view", "click", "error"))]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["S3_simple", "S6_apache", "S7_iis", "S9_iptables", "S10_firewall"])
def test_addresses(name, spark, users):
    columns, rows = _same(spark, users, name)
    at = next(i for i, c in enumerate(columns) if c in ("ip", "rhost", "c_ip", "src", "src_host"))
    assert len({r[at] for r in rows}) == 7 and "None" not in {r[at] for r in rows}


def test_ports_of_all_users(spark, users):
    assert len(_same(spark, users, "J21_all_ports")[1]) == 7
    assert len(_same(spark, users, "J21_either_ports")[1]) == 2


def test_cidr_blocks_of_long_ranges(spark, tmp_path):
    rows = [(1, 3, 4096), (2, 167772161, 4097), (3, 0, 1 << 24), (4, 5, 100_000_000), (5, 7, 0), (6, None, 9), (7, 0, 1 << 32)]
    spark.createDataFrame(rows, "id int, start_ip long, numhosts long").write.parquet(str(tmp_path / "whois.parquet"))
    want = set()
    for i, low, n in rows:
        if low is not None and n:
            blocks = ipaddress.summarize_address_range(ipaddress.IPv4Address(low), ipaddress.IPv4Address(low + n - 1))
            want |= {(i, int(b.network_address), b.prefixlen) for b in blocks}
    assert {tuple(r) for r in registry.QUERIES["X27_cidr_blocks"](spark, str(tmp_path)).collect()} == want
