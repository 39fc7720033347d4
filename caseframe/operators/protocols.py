"""Protocol streams and record files to their tables: HTTP exchanges and parameters, FTP control streams, IRC messages, event
logs and browser history. Each scanner reads one object in one pass (see :mod:`caseframe.operators.scanners`)."""

from __future__ import annotations

import email
import email.policy
import re
import struct
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.operators.scanners import http_messages, scan

# ---- HTTP -----------------------------------------------------------------------------------------------------------

MESSAGE = "inode_id long, n int, method string, url string, status int, content_type string, headers map<string,string>, size long"


def http_numbered(key: int, raw: bytes) -> Iterator[tuple]:
    """Messages of one direction, numbered in order; informational responses (1xx) answer nothing and have no number."""
    n = 0
    for _, method, url, status, kind, headers, body in http_messages(key, raw):
        if status is not None and 100 <= status < 200:
            continue
        yield key, n, method, url, status, kind, headers, len(body)
        n += 1


def exchanges(streams: DataFrame, pairs: DataFrame) -> DataFrame:
    """inode_id, n, method, url, host, useragent, referrer, status, content_type, size: requests with the response of the
    same number in the reverse direction; null where there is none. pairs: inode_id (of requests), reverse."""
    messages = scan(streams, http_numbered, MESSAGE)
    ask = messages.filter("status is null").join(pairs, "inode_id", "left")
    told = messages.filter("status is not null").select(F.col("inode_id").alias("reverse"), "n", "status", F.col("content_type"), "size")
    head = lambda k: F.col("headers")[k]
    asked = ask.select("inode_id", "reverse", "n", "method", "url", head("host").alias("host"), head("user-agent").alias("useragent"), head("referer").alias("referrer"))
    return asked.join(told, ["reverse", "n"], "left").drop("reverse")


PARAMETER = "inode_id long, n int, source string, name string, value string"


def http_parameters(key: int, raw: bytes) -> Iterator[tuple]:
    """Parameters of requests: of the query, of form bodies (also of several parts, whose files are named but not read) and
    cookies."""
    n = -1
    for _, _method, url, status, kind, headers, body in http_messages(key, raw):
        if status is not None:
            continue
        n += 1
        held = dict(headers)
        for name, value in parse_qsl(urlsplit(url).query, keep_blank_values=True):
            yield key, n, "query", name, value
        kind = (kind or "").lower()
        if kind.startswith("application/x-www-form-urlencoded"):
            for name, value in parse_qsl(body.decode("utf-8", "replace"), keep_blank_values=True):
                yield key, n, "body", name, value
        elif kind.startswith("multipart/form-data"):
            whole = b"Content-Type: " + held["content-type"].encode("latin-1") + b"\r\n\r\n" + body
            for part in email.message_from_bytes(whole, policy=email.policy.HTTP).iter_parts():
                name, file = part.get_param("name", header="content-disposition"), part.get_filename()
                if name is not None:
                    yield key, n, "body", name, file if file is not None else (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
        for pair in filter(None, (x.strip() for x in held.get("cookie", "").split(";"))):
            name, _, value = pair.partition("=")
            yield key, n, "cookie", name, value


# ---- FTP and IRC ----------------------------------------------------------------------------------------------------

FTP_LINE = "inode_id long, n int, command string, argument string, code int, reply string"


def ftp_control(key: int, raw: bytes) -> Iterator[tuple]:
    """Commands of a control stream (both directions in order of time) with the last reply before the next command; replies
    before the first command have an empty one. Lines of a reply are joined."""
    n, command, code, reply = 0, ("", ""), None, []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        said = re.match(r"([1-5][0-9]{2})[ -]", line)
        if said or (reply and line.startswith(" ")):
            code = int(said.group(1)) if said else code
            reply.append(line[4:] if said else line.strip())
        elif line:
            if command[0] or reply:
                yield key, n, *command, code, "\n".join(reply) if reply else None
                n += 1
            word, _, rest = line.partition(" ")
            command, code, reply = (word.upper(), rest), None, []
    if command[0] or reply:
        yield key, n, *command, code, "\n".join(reply) if reply else None


def ftp_sessions(lines: DataFrame) -> DataFrame:
    """inode_id, username, password, server_banner, welcome_banner of :func:`ftp_control` rows; of several logins the last."""
    last = lambda col, test: F.max_by(col, F.when(test, F.col("n")))
    return lines.groupBy("inode_id").agg(
        last("argument", F.col("command") == "USER").alias("username"),
        last("argument", F.col("command") == "PASS").alias("password"),
        F.min_by("reply", F.when(F.col("command") == "", F.col("n"))).alias("server_banner"),
        last("reply", F.col("code") == 230).alias("welcome_banner"),
    )


IRC = "inode_id long, n int, sender string, full_sender string, command string, recipient string, data string"


def irc(key: int, raw: bytes) -> Iterator[tuple]:
    """Messages of an IRC stream: who sent them (nick and full name), the command, its first argument and the text."""
    for n, line in enumerate(x for x in re.split(r"\r?\n", raw.decode("utf-8", "replace")) if x):
        full = None
        if line.startswith(":"):
            full, _, line = line[1:].partition(" ")
        head, colon, text = line.partition(" :")
        command, _, rest = head.partition(" ")
        words = rest.split()
        yield key, n, full and full.split("!")[0], full, command.upper(), words[0] if words else None, text if colon else " ".join(words[1:]) or None


# ---- records --------------------------------------------------------------------------------------------------------

EVENT = "inode_id long, record long, time timestamp, event long, type int, source string, machine string, args array<string>"


def _wide(raw: bytes, at: int) -> tuple[str, int]:
    """A text of two bytes a character up to a zero, and where it ends."""
    end = at
    while raw[end : end + 2] not in (b"\0\0", b"", b"\0"):
        end += 2
    return raw[at:end].decode("utf-16-le", "replace"), end + 2


def event_log(key: int, raw: bytes) -> Iterator[tuple]:
    """Records of a Windows event log, found by their mark at any offset, so that a log that was overwritten in a circle or
    is torn is read as far as it goes."""
    at = raw.find(b"LfLe", 0)
    while at >= 4:
        size = struct.unpack_from("<I", raw, at - 4)[0]
        if size >= 56 and at - 4 + size <= len(raw):
            number, made, _, event, kind, strings, _, _, _, offset = struct.unpack_from("<IIIIHHHHII", raw, at + 4)
            body = raw[at - 4 : at - 4 + size]
            source, end = _wide(body, 56)
            machine, _ = _wide(body, end)
            args = []
            for _ in range(strings):
                text, offset = _wide(body, offset)
                args.append(text)
            yield key, number, pd.Timestamp(made, unit="s", tz="UTC"), event & 0xFFFF, kind, source, machine, args
        at = raw.find(b"LfLe", at + 4)


HISTORY = "inode_id long, offset long, length long, type string, url string, modified timestamp, accessed timestamp, filename string, headers string"


def _filetime(ticks: int) -> pd.Timestamp | None:
    return pd.Timestamp(ticks // 10 - 11_644_473_600_000_000, unit="us", tz="UTC") if ticks else None


def history(key: int, raw: bytes) -> Iterator[tuple]:
    """URL and REDR records of a browser's index file, in blocks of 128 bytes; records of a length that leaves the file are
    passed over."""
    text = lambda body, at: body[at : body.find(b"\0", at)].decode("latin-1") if 0 < at < len(body) else None
    for at in range(0, len(raw) - 7, 128):
        kind = raw[at : at + 4]
        if kind not in (b"URL ", b"REDR"):
            continue
        size = struct.unpack_from("<I", raw, at + 4)[0] * 128
        body = raw[at : at + size]
        if not size or len(body) < size:
            continue
        if kind == b"REDR":
            yield key, at, size, "REDR", text(body, 16), None, None, None, None
            continue
        modified, accessed = struct.unpack_from("<QQ", body, 8)
        url, name, heads = (struct.unpack_from("<I", body, x)[0] for x in (0x34, 0x3C, 0x44))
        length = struct.unpack_from("<I", body, 0x48)[0]
        headers = body[heads : heads + length].decode("latin-1") if heads else None
        yield key, at, size, "URL", text(body, url), _filetime(modified), _filetime(accessed), text(body, name), headers
