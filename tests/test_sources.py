"""Readers over files, presets, exports, scanners over made bytes, streams of files."""

import datetime as dt
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from caseframe import cli
from caseframe import columns as C
from caseframe.operators import flows, index, lookup, scanners
from caseframe.sources import exports, listing, logs
from caseframe.streaming import ingest


def test_text_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("# head\n1 10.0.0.1 x\n\n2 10.0.0.2 y")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("3 bad z\n")
    rows = logs.simple(logs.read_lines(spark, str(tmp_path)), [C.IntegerType("n"), C.IPType("ip"), C.StringType("s")])
    assert {tuple(r) for r in rows.collect()} == {(1, 0x0A000001, "x"), (2, 0x0A000002, "y"), (3, None, "z")}
    assert {r["name"] for r in listing.storage(spark, str(tmp_path)).collect()} == {"a.log", "b.log.gz"}


def test_presets(spark, tmp_path):
    lines = spark.createDataFrame([("1,a",), ("2,b",)], "value string")
    p = logs.Presets()
    p.save(logs.Preset("two", "csv", [("IntegerType", "n"), ("StringType", "s")]))
    table = p.load_table("two", "trial", lines)
    assert spark.table(table).count() == 2 and p.loaded("two") == ["trial"]
    p.drop(spark, "two")
    assert not spark.catalog.tableExists(table) and p.loaded("two") == []


def test_repeats(spark):
    rows = spark.createDataFrame([("k", 1, None), ("k", 2, 3), ("k", 3, None), ("k", 4, None), ("j", 5, 2)], "k string, o int, times int")
    got = logs.repeated(rows, "k", "o", "times")
    assert sorted((r["o"], r["copy"]) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 0), (4, 0)]


def test_apache_formats():
    for form in logs.APACHE_FORMATS:
        pattern, types = logs.apache_pattern(form)
        assert types and pattern.startswith("^")


def test_command_line(spark, tmp_path):
    df = spark.createDataFrame([(1, 0x0A000001, 'a "q"'), (2, 0x0A000102, "b,c")], "n long, ip long, s string")
    cli.export(df, ["n", "ip", "s"], "ip netmask 10.0.0.0/24", str(tmp_path / "out"), ("ip",))
    assert [tuple(r) for r in spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out")).collect()] == [("1", "10.0.0.1", 'a "q"')]


def test_changes(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, s string")
    assert {tuple(r) for r in exports.without_duplicates(df, ["id"], "s").collect()} == {(1, "a"), (None, "c")}
    assert exports.deleted(df, F.col("id") == 1).collect() == [(None, "c")]


def test_incremental(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    read = lambda lines: logs.simple(lines, [C.IntegerType("n")])
    (tmp_path / "in" / "1.log").write_text("1\n2\n")
    ingest.new_files(spark, source, state, out, read).awaitTermination()
    (tmp_path / "in" / "2.log").write_text("3\n")
    ingest.new_files(spark, source, state, out, read).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_containers():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("f")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert list(scanners.container(1, tar.getvalue())) == [(1, "f", b"abc")]
    assert list(scanners.container(1, gzip.compress(b"xyz"))) == [(1, "gz", b"xyz")]
    assert list(scanners.container(1, b"")) == []


def test_damaged_objects_give_no_rows(spark):
    objects = spark.createDataFrame([(1, bytearray(b"PK\3\4broken")), (2, None), (3, bytearray(b"")), (4, bytearray(b"SQLite format 3\0broken"))], "inode_id long, content binary")
    for f, schema, _ in scanners.SCANNERS.values():
        scanners.scan(objects, f, schema).collect()
    assert scanners.ordered(["mail"]) == ["container", "mail"]


def test_mail():
    raw = b"From: a@b\nTo: c@d\nSubject: hi\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=latin-1\n\ncaf\xe9\n--x\nContent-Type: image/png\n\nzz\n--x--\n"
    rows = list(scanners.mail(5, raw))
    assert [(r[3], r[5], r[6]) for r in rows] == [("hi", 0, "text/plain"), ("hi", 1, "image/png")] and rows[0][7].strip() == "café"


def test_odd_mail(spark):
    """Heads beyond ASCII are text; a body that isn't text ends its message, not the job."""
    mails = [(1, "From: Jürgen <j@x>\nTo: 李\nSubject: Grüße\n übrigens\nDate: né\n\nhi".encode()), (2, b"From: a\nSubject: caf\xe9\nSubject: b\n\nhi"), (3, b"From: a\nContent-Type: text/plain; charset=utf-7\n\n+2AA- x"), (4, b"From: a\n\nlast")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in mails], "inode_id long, content binary").coalesce(1)
    want = [(1, "Jürgen <j@x>", "李", "Grüße\n übrigens", "né", 0, "text/plain", "hi"), (2, "a", None, "caf\ufffd", None, 0, "text/plain", "hi"), (4, "a", None, None, None, 0, "text/plain", "last")]
    assert sorted(map(tuple, scanners.scan(df, scanners.mail, scanners.MAIL).collect())) == want
    rows = scanners.scan(df, scanners.mail, scanners.MAIL, errors=True).collect()
    assert [(r["inode_id"], r["error"].split(":")[0]) for r in rows if r["error"]] == [(3, "UnicodeEncodeError")] and len(rows) == 4


def test_frames():
    tcp = b"\x00" * 12 + b"\x08\x00" + bytes([0x45, 0, 0, 43, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + b"\x04\x01\x00\x50\x00\x00\x00\x07" + bytes(4) + b"\x50" + bytes(7) + b"abc"
    assert list(scanners.ethernet(1, tcp)) == [(1, 0x0A000001, 1025, 0x0A000002, 80, 6, 7, b"abc")]


def test_reassembly(spark):
    seg = [(1, 100, b"abc"), (2, 106, b"ghi"), (3, 103, b"def"), (4, 101, b"XX"), (5, 107, b"HIJ"), (6, 112, b"mn"), (7, 114, b"")]
    df = spark.createDataFrame([(i, 1, 1, s, bytearray(b)) for i, s, b in seg], "id long, stream long, session long, seq long, data binary")
    r = flows.reassembled(df).first()
    assert bytes(r["content"]) == b"abcdefghiJ\0\0mn"
    assert set(r["events"]) >= {"1:est", "4:retran", "6:gap", "7:misc", "7:destroy"}


def test_small_patterns():
    m = index.Matcher([(1, "a.c", "regex"), (2, "[0-9]{1,3}", "regex"), (3, "Secret", "word"), (4, "cret", "literal"), (5, "x?y", "regex"), (6, "(a|b)", "regex")])
    hits = set(m.hits("a\nc 1234 sEcRet secret xy (a|b)"))
    assert {(0, 1, 3), (4, 2, 3), (5, 2, 3), (6, 2, 2), (7, 2, 1), (9, 3, 6), (16, 3, 6), (18, 4, 4), (23, 5, 2), (24, 5, 1), (26, 6, 5)} <= hits
    assert (11, 4, 4) not in hits


def test_index_edges(spark):
    words = spark.createDataFrame([(1, "ab", "word", "x"), (2, None, "word", "x")], "word_id long, word string, word_type string, class string")
    docs = spark.createDataFrame([(1, "abAB"), (2, None), (3, ""), (4, "İab")], "inode_id long, content string")
    assert {tuple(r) for r in index.scan(docs, words).collect()} == {(1, 1, 0, 2), (1, 1, 2, 2), (4, 1, 1, 2)}
    raw = docs.select("inode_id", F.encode("content", "UTF-16LE").alias("content"))
    entry = spark.createDataFrame([(1, "a\0b\0", "literal", "x")], "word_id long, word string, word_type string, class string")
    assert {tuple(r) for r in index.scan(raw, entry).collect()} == {(1, 1, 0, 4), (4, 1, 2, 4)}
    assert index.scan(docs, words.limit(0)).count() == 0


def test_dates(spark):
    from caseframe.functions import dates

    assert dates.guess_date("3 Feb 2010 04:05:06") == dt.datetime(2010, 2, 3, 4, 5, 6)
    assert dates.guess_date("1138798072") == dt.datetime(2006, 2, 1, 12, 47, 52)


def test_w3c_sections(spark, tmp_path):
    """Each line is read under the header before it in its own file."""
    (tmp_path / "a.log").write_text("#Fields: date time c-ip sc-status\n2008-01-01 10:00:00 10.0.0.1 200\n#Fields: date time sc-status c-ip cs-uri\n2008-01-01 10:00:01 404 10.0.0.2 /x\n")
    (tmp_path / "b.log").write_text("2007-01-01 lost\n#Fields: date time c-ip sc-status\n2008-01-01 10:00:02 10.0.0.3 500\n")
    rows = logs.iis_sections(logs.w3c_lines(spark, str(tmp_path)))
    got = sorted((str(r["timestamp"]), r["c_ip"], r["sc_status"], r["cs_uri"]) for r in rows.collect())
    assert got == [("2008-01-01 10:00:00", 167772161, 200, None), ("2008-01-01 10:00:01", 167772162, 404, "/x"), ("2008-01-01 10:00:02", 167772163, 500, None)]


def test_many_masks(spark):
    """Other numbers than masks push no route out, and all 33 masks count."""
    routes = [(167772161 & (0xFFFFFFFF << (32 - b)), (0xFFFFFFFF << (32 - b)) & 0xFFFFFFFF, b) for b in range(33)] + [(0, m, 99) for m in range(1, 41)] + [(5, None, 7)]
    df = spark.createDataFrame(routes, "network long, netmask long, whois_id int")
    ips = spark.createDataFrame([(167772161,), (167772160,), (None,)], "ip long")
    assert {tuple(r) for r in lookup.longest_prefix(ips, "ip", df).collect()} == {(167772161, 32), (167772160, 31)}


def test_broken_objects(spark, monkeypatch):
    """What was read before an error stays, and the error can be had as a row; members that are too large have no content."""
    ok = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n"
    df = spark.createDataFrame([(1, bytearray(ok + b"GET /b HTTP/1.1\r\nContent-Length: x\r\n\r\n")), (2, bytearray(ok)), (3, None)], "inode_id long, content binary")
    assert sorted((r["inode_id"], r["url"]) for r in scanners.scan(df, scanners.http_messages, scanners.HTTP).collect()) == [(1, "http://h/a"), (2, "http://h/a")]
    rows = scanners.scan(df, scanners.http_messages, scanners.HTTP, errors=True).collect()
    assert [(r["inode_id"], "x" in r["error"]) for r in rows if r["error"]] == [(1, True)] and len(rows) == 3
    monkeypatch.setattr(scanners, "MAX_MEMBER", 10)
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("small", b"x" * 10)
        z.writestr("large", b"x" * 11)
    assert [(m, c) for _, m, c in scanners.unzip(1, made.getvalue())] == [("small", b"x" * 10), ("large", None)]
    assert [c for _, _, c in scanners.gunzip(1, gzip.compress(b"y" * 11))] == [None]


def test_deep_nesting(spark):
    """Containers are opened to the last, however deep."""
    raw = b"core"
    for _ in range(9):
        raw = gzip.compress(raw)
    rows = scanners.scan_nested(spark.createDataFrame([(1, bytearray(raw)), (2, None)], "inode_id long, content binary")).collect()
    assert sorted(r["level"] for r in rows) == list(range(1, 10)) and [bytes(r["content"]) for r in rows if r["level"] == 9] == [b"core"]
    with pytest.raises(ValueError):
        scanners.scan_nested(spark.createDataFrame([(1, bytearray(raw))], "inode_id long, content binary"), most=4)


def test_large_gap(spark):
    """A gap above the window is listed instead of filled, so that later offsets can be told."""
    far = flows.WINDOW + 100
    df = spark.createDataFrame([(1, 1, 1, 0, bytearray(b"ab")), (2, 1, 1, 4, bytearray(b"cd")), (3, 1, 1, far, bytearray(b"ef"))], "id long, stream long, session long, seq long, data binary")
    r = flows.reassembled(df).first()
    assert bytes(r["content"]) == b"ab\0\0cdef" and [tuple(g) for g in r["gaps"]] == [(6, far - 6)]


def test_wide_words(spark):
    """Binary content is searched in every encoding of a word, by bytes; literals and patterns as they stand."""
    dictionary = spark.createDataFrame([(1, "Report", "word", "c"), (2, "ab", "literal", "c"), (3, "ab", "word", "c"), (4, "\u0416\u0416", "literal", "c"), (5, "m\u00fc", "word", "c")], "word_id long, word string, word_type string, class string")
    content = "xREPORT".encode("utf-16-le") + b"--report ab" + "M\u00fc".encode("utf-16-le") + "m\u00fc".encode()
    df = spark.createDataFrame([(7, bytearray(content))], "inode_id long, content binary")
    got = {(r["word_id"], r["offset"], r["length"]) for r in index.scan(df, dictionary).collect()}
    assert got == {(1, 2, 12), (1, 16, 6), (2, 23, 2), (5, 25, 4), (5, 29, 3)}


def test_stored_files(spark):
    lines = spark.createDataFrame([("Jan  2 03:04:05 fw %PIX-6-303002: 192.168.0.1 Stored 192.168.3.1:filename.ext",), ("Jan  2 03:04:06 fw %PIX-6-303002: 192.168.0.2 Retrieved 192.168.3.1:other",)], "value string")
    got = [(r["action"], r["src_host"], r["dst_host"]) for r in logs.pix_connections(logs.pix_messages(lines)).collect()]
    assert got == [("Stored", 3232235521, 3232236289), ("Retrieved", 3232235522, 3232236289)]
