"""Scanners: bytes of objects to rows. Types and digests are native; containers, mail, databases and protocols are read by
the standard library in Arrow batches, one pass over the objects each. What was read of an object before an error stays; the
error is a row of its own if asked for."""

from __future__ import annotations

import email
import email.policy
import gzip
import io
import sqlite3
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.operators.parallel import spread
from caseframe.session import Stages

# What content starts with: type, mime, offset range, pattern, score.
MAGIC = [
    ("PDF document", "application/pdf", 0, 0, "%PDF-", 80),
    ("HTML document text", "text/html", 0, 1024, "<html", 60),
    ("HTML document text", "text/html", 0, 1024, "<title", 30),
    ("RFC 822 mail text", "message/rfc822", 0, 0, "From: ", 70),
    ("RFC 822 mail text", "message/rfc822", 0, 1024, "\nSubject: ", 40),
    ("chat transcript", "text/plain", 0, 0, "[", 30),
    ("chat transcript", "text/plain", 4, 12, "] <", 40),
    ("web page text", "text/plain", 0, 200, "| home | about", 60),
]
BASE = ("plain text", "text/plain", 10)


def magic_scores(objects: DataFrame, key: str, content: str, rules: list = MAGIC) -> DataFrame:
    """(key, type, mime, score) of the type with the highest score: each rule whose pattern occurs in its range of offsets adds
    its score, plain text has a base score. Ties go to the first name. Null content has no row.

    The rules are literals of the plan, so scoring is one projection without a join.
    """
    head = F.substring(F.col(content), 1, 2048)
    types: dict[str, tuple[str, Column]] = {BASE[0]: (BASE[1], F.lit(BASE[2]))}
    for name, mime, low, high, pattern, score in rules:
        at = F.instr(F.substring(head, low + 1, high - low + len(pattern)), pattern)
        hit = F.when(at > 0, score).otherwise(0)
        old = types.get(name)
        types[name] = (mime, hit if old is None else old[1] + hit)
    scored = F.array(*[F.struct(s.cast("int").alias("score"), F.lit(t).alias("type"), F.lit(m).alias("mime")) for t, (m, s) in sorted(types.items())])
    best = F.aggregate(scored, F.struct(F.lit(-1).alias("score"), F.lit("").alias("type"), F.lit("").alias("mime")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return objects.filter(F.col(content).isNotNull()).select(key, best.alias("b")).select(key, "b.type", "b.mime", "b.score")


def digests(objects: DataFrame, key: str, content: str, known: DataFrame | None = None, least: int = 16) -> DataFrame:
    """(key, md5, product) of contents of at least ``least`` bytes; ``known``: md5, product."""
    rows = objects.filter(F.octet_length(content) >= least).select(key, F.upper(F.md5(content)).alias("md5"))
    if known is None:
        return rows
    named = known.groupBy("md5").agg(F.min("product").alias("product"))
    return rows.join(named, "md5", "left").select(key, "md5", F.coalesce("product", F.lit("-")).alias("product"))


def html_title(c: Column) -> Column:
    return html_text(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(c: Column) -> Column:
    """Targets of links in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)), html_text)


def html_text(c: Column) -> Column:
    """Without tags, the common entities decoded."""
    bare = F.regexp_replace(c, "(?s)<[^>]*>", "")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(ch))
    return bare


# ---- scanners over bytes --------------------------------------------------------------------------------------------

Scan = Callable[[int, bytes], Iterable[tuple]]


def scan(objects: DataFrame, scanner: Scan, schema: str, key: str = "inode_id", content: str = "content", errors: bool = False) -> DataFrame:
    """Rows that ``scanner`` gives for each object. An error ends that object only, as does a row that the schema can't hold; the rows before
    it stay. With ``errors`` there is a column ``error``, null but for one more row of each such object, which has the key and the error."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"{schema}, error string" if errors else schema
    fields = to_arrow_schema(_parse_datatype_string(schema))
    wanted = len(fields) - errors

    def arrays(rows: list[tuple]) -> list[pa.Array]:
        columns = list(zip(*rows)) if rows else [[] for _ in fields]
        return [pa.array(c, f.type) for c, f in zip(columns, fields)]

    def said(k: object, e: Exception) -> tuple:
        return k, *[None] * (wanted - 1), f"{type(e).__name__}: {e}".encode("utf-8", "replace").decode()

    def held(rows: list[tuple], ends: list[tuple]) -> Iterator[tuple]:
        """The rows of each object (its key, where they end) before the first that the schema can't hold."""
        start = 0
        for k, end in ends:
            for row in rows[start:end]:
                try:
                    arrays([row])
                    yield row
                except Exception as e:  # noqa: BLE001 - values of unknown origin
                    if errors:
                        yield said(k, e)
                    break
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ends: list[tuple] = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if raw is None:
                    continue
                try:
                    for row in scanner(k, raw.encode("utf-8") if isinstance(raw, str) else raw):
                        rows.append((*row, None) if errors else row)
                except Exception as e:  # noqa: BLE001 - bytes of unknown origin
                    if errors:
                        rows.append(said(k, e))
                ends.append((k, len(rows)))
            try:
                got = arrays(rows)
            except Exception:  # noqa: BLE001
                got = arrays(list(held(rows, ends)))
            yield pa.RecordBatch.from_arrays(got, schema=fields)

    return spread(objects.select(key, content)).mapInArrow(run, schema)


MEMBER = "inode_id long, member string, content binary"
MAX_MEMBER = 256 << 20  # a larger member, as one that is damaged, is a row without content


def _member(key: int, name: str, stream: io.BufferedIOBase) -> tuple:
    raw = stream.read(MAX_MEMBER + 1)
    return key, name, raw if len(raw) <= MAX_MEMBER else None


def unzip(key: int, raw: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if not info.is_dir():
                try:
                    with z.open(info) as f:
                        yield _member(key, info.filename, f)
                except (RuntimeError, zipfile.BadZipFile, NotImplementedError, zlib.error, EOFError):
                    yield key, info.filename, None


def gunzip(key: int, raw: bytes) -> Iterator[tuple]:
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
        yield _member(key, "gz", f)


def untar(key: int, raw: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        for m in t:
            if m.isfile():
                yield _member(key, m.name, t.extractfile(m))


def container(key: int, raw: bytes) -> Iterator[tuple]:
    """Members of a zip, gzip or tar file by its first bytes."""
    if raw[:4] == b"PK\3\4":
        yield from unzip(key, raw)
    elif raw[:2] == b"\x1f\x8b":
        yield from gunzip(key, raw)
    elif raw[257:262] == b"ustar":
        yield from untar(key, raw)


MAIL = "inode_id long, sender string, recipient string, subject string, date string, part int, content_type string, body string"


def mail(key: int, raw: bytes) -> Iterator[tuple]:
    """One row per text or attachment part of a message."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    heads: dict[str, str] = {}
    for name, value in m.raw_items():
        # Bytes beyond ASCII are escaped in the raw value; by name they would come as Header objects, which aren't text.
        heads.setdefault(name.lower(), value.encode("ascii", "surrogateescape").decode("utf-8", "replace"))
    sender, recipient, subject, date = map(heads.get, ("from", "to", "subject", "date"))
    if not (sender or subject):
        return
    for i, part in enumerate(p for p in m.walk() if not p.is_multipart()):
        body = part.get_payload(decode=True) or b""
        yield key, sender, recipient, subject, date, i, part.get_content_type(), body.decode(part.get_content_charset() or "utf-8", "replace")


TABLE_ROW = "inode_id long, tbl string, row long, values map<string,string>"


def sqlite_rows(key: int, raw: bytes) -> Iterator[tuple]:
    """Every row of every table of an embedded database."""
    if raw[:16] != b"SQLite format 3\0":
        return
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(raw)
        for (tbl,) in db.execute("select name from sqlite_master where type = 'table' order by name").fetchall():
            cur = db.execute('select * from "{}"'.format(tbl.replace('"', '""')))
            names = [x[0] for x in cur.description]
            for i, r in enumerate(cur):
                yield key, tbl, i, [(n, None if v is None else str(v)) for n, v in zip(names, r)]
    finally:
        db.close()


# First bytes of what is carved.
SIGNATURES = {"jpeg": b"\xff\xd8\xff", "zip": b"PK\x03\x04", "script": b"#!/"}
CARVED = "inode_id long, kind string, offset long, length long"


def carve(key: int, raw: bytes) -> Iterator[tuple]:
    """Header offsets of known kinds; a picture ends at its end mark, a script at its first zero byte or non-text byte."""
    for kind, mark in SIGNATURES.items():
        at = raw.find(mark)
        while at >= 0:
            end = len(raw)
            if kind == "jpeg":
                stop = raw.find(b"\xff\xd9", at)
                end = stop + 2 if stop >= 0 else end
            elif kind == "script":
                stop = next((i for i in range(at, len(raw)) if raw[i] not in b"\t\n\r" and not 32 <= raw[i] < 127), end)
                end = stop
            yield key, kind, at, end - at
            at = raw.find(mark, at + 1)


PACKET = "file string, id long, offset long, length int, ts timestamp, data binary"


def pcap_packets(key: str, raw: bytes) -> Iterator[tuple]:
    """Packets of a capture file, in either byte order, with micro- or nanoseconds."""
    magic = raw[:4]
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}[magic]
    at, n = 24, 0
    while at + 16 <= len(raw):
        sec, sub, have, _ = struct.unpack_from(order[0] + "IIII", raw, at)
        if at + 16 + have > len(raw):
            break
        yield key, n, at + 16, have, pd.Timestamp(sec * 1_000_000 + sub // order[1], unit="us", tz="UTC"), raw[at + 16 : at + 16 + have]
        at, n = at + 16 + have, n + 1


FRAME = "id long, src_ip long, src_port int, dest_ip long, dest_port int, proto int, seq long, data binary"


def ethernet(key: int, raw: bytes) -> Iterator[tuple]:
    """TCP and UDP payloads of Ethernet frames with IPv4."""
    if raw[12:14] != b"\x08\x00":
        return
    ip = raw[14:]
    head, total, proto = (ip[0] & 15) * 4, struct.unpack_from(">H", ip, 2)[0], ip[9]
    src, dest = struct.unpack_from(">II", ip, 12)
    body = ip[head:total]
    if proto == 6:
        sport, dport, seq = struct.unpack_from(">HHI", body)
        yield key, src, sport, dest, dport, proto, seq, body[(body[12] >> 4) * 4 :]
    elif proto == 17:
        sport, dport = struct.unpack_from(">HH", body)
        yield key, src, sport, dest, dport, proto, None, body[8:]


DNS = "inode_id long, kind string, name string, target string"


def _dns_name(raw: bytes, at: int) -> tuple[str, int]:
    labels, end, hops = [], None, 0
    while raw[at]:
        n = raw[at]
        if n >= 192:
            end = end or at + 2
            at = struct.unpack_from(">H", raw, at)[0] & 0x3FFF
            hops += 1
            if hops > 50:
                raise ValueError("names point in a circle")
            continue
        labels.append(raw[at + 1 : at + 1 + n].decode("latin-1"))
        at += n + 1
    return ".".join(labels), end or at + 1


def dns(key: int, raw: bytes) -> Iterator[tuple]:
    """Answers of a DNS message: addresses and aliases; an alias is resolved through the addresses of the same message by a
    join of the rows on name."""
    questions, answers = struct.unpack_from(">HH", raw, 4)
    at = 12
    for _ in range(questions):
        _, at = _dns_name(raw, at)
        at += 4
    for _ in range(answers):
        name, at = _dns_name(raw, at)
        kind, _, _, n = struct.unpack_from(">HHIH", raw, at)
        at += 10
        if kind == 1:
            yield key, "A", name, ".".join(map(str, raw[at : at + 4]))
        elif kind == 5:
            yield key, "CNAME", name, _dns_name(raw, at)[0]
        at += n


HTTP = "inode_id long, method string, url string, status int, content_type string, headers map<string,string>, body binary"


def _http_head(raw: bytes) -> tuple[list[str], list[tuple[str, str]], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    pairs = {}
    for x in lines[1:]:
        k, colon, v = x.partition(":")
        if colon:
            pairs[k.strip().lower()] = v.strip()
    return lines[0].split(" ", 2), list(pairs.items()), rest


def _unchunked(raw: bytes) -> tuple[bytes, bytes]:
    out = bytearray()
    while raw:
        size, _, raw = raw.partition(b"\r\n")
        n = int(size.split(b";")[0] or b"0", 16)
        if n == 0:
            return bytes(out), raw[2:]
        out += raw[:n]
        raw = raw[n + 2 :]
    return bytes(out), raw


def http_messages(key: int, raw: bytes) -> Iterator[tuple]:
    """Requests and responses of one direction of a stream: heads, chunked and gzip bodies. Content type defaults to
    text/html, method to ``-``."""
    while raw.strip():
        first, pairs, raw = _http_head(raw)
        headers = dict(pairs)
        response = first[0].startswith("HTTP/")
        if headers.get("transfer-encoding", "").lower() == "chunked":
            body, raw = _unchunked(raw)
        else:
            n = int(headers.get("content-length", len(raw) if response else 0))
            body, raw = raw[:n], raw[n:]
        if headers.get("content-encoding") == "gzip":
            body = zlib.decompress(body, 47)
        if response:
            yield key, "-", None, int(first[1]), headers.get("content-type", "text/html"), pairs, body
        else:
            url = first[1] if first[1].startswith("http") else f"http://{headers.get('host', '')}{first[1]}"
            yield key, first[0], url, None, headers.get("content-type"), pairs, body


LINES = "inode_id long, n int, command string, argument string"


def commands(key: int, raw: bytes) -> Iterator[tuple]:
    """Command lines of SMTP, POP, FTP and IRC streams: an optional source, the command in capitals, its argument."""
    for n, line in enumerate(raw.decode("latin-1").splitlines()):
        words = line.split(" ", 1) if not line.startswith(":") else line.split(" ", 2)[1:]
        if words and words[0]:
            yield key, n, words[0].upper(), words[1] if len(words) > 1 else ""


# Commands that carry credentials.
CREDENTIALS = {"USER": "username", "PASS": "password", "AUTH": "mechanism", "NICK": "username"}


def credentials(rows: DataFrame) -> DataFrame:
    """(inode_id, username, password) of command streams."""
    return rows.filter(F.col("command").isin("USER", "PASS", "NICK")).groupBy("inode_id").agg(
        F.min_by("argument", F.when(F.col("command") != "PASS", F.col("n"))).alias("username"), F.min(F.when(F.col("command") == "PASS", F.col("argument"))).alias("password")
    )


# ---- running scanners -----------------------------------------------------------------------------------------------

SCANNERS: dict[str, tuple[Scan, str, tuple[str, ...]]] = {
    "container": (container, MEMBER, ()),
    "mail": (mail, MAIL, ("container",)),
    "sqlite": (sqlite_rows, TABLE_ROW, ("container",)),
    "carve": (carve, CARVED, ()),
    "http": (http_messages, HTTP, ()),
    "dns": (dns, DNS, ()),
    "commands": (commands, LINES, ()),
}


def ordered(names: Iterable[str]) -> list[str]:
    """Scanners with those they depend on, these first."""
    out: list[str] = []

    def visit(n: str, above: tuple[str, ...] = ()) -> None:
        if n in above:
            raise ValueError(f"scanners depend on each other: {above + (n,)}")
        for x in SCANNERS[n][2]:
            visit(x, (*above, n))
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def scan_all(objects: DataFrame, names: Iterable[str], done: DataFrame | None = None) -> dict[str, DataFrame]:
    """A table per scanner. ``done`` (inode_id, scanner) are objects that a scanner has seen; it skips them."""
    out = {}
    for n in ordered(names):
        todo = objects
        if done is not None:
            todo = objects.join(done.filter(F.col("scanner") == n).select("inode_id"), "inode_id", "left_anti")
        f, schema, _ = SCANNERS[n]
        out[n] = scan(todo, f, schema)
    return out


def _other_members(key: int, raw: bytes) -> Iterator[tuple]:
    return (row for row in container(key, raw) if row[2] != raw)


def scan_nested(objects: DataFrame, most: int = 64) -> DataFrame:
    """Members of containers within containers, to the last: level, inode_id, member, content. A member that is equal to
    the container it lies in is left out; more than ``most`` levels are an error. Each level is written once."""
    stages = Stages(objects.sparkSession, "nested")
    todo = objects.select("inode_id", "content")
    for k in range(1, most + 2):
        rows = scan(todo, _other_members, MEMBER)
        level = stages.write(rows.withColumn("level", F.lit(k)), n=F.count(F.lit(1)))
        if not stages.seen["n"]:
            break
        if k > most:
            raise ValueError(f"containers lie in each other more than {most} deep")
        todo = level.filter("content is not null").select("inode_id", "content")
    return stages.read()
