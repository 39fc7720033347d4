"""Log readers: a table of text lines (column ``value``) to typed rows. Each is one projection over the text scan, so it needs
no shuffle and its columns are pruned like any others; :func:`read_lines` is the scan for files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe import filterlang
from caseframe.functions import dates, net
from caseframe.operators.running import running


def keep_records(lines: DataFrame, comments: bool = True) -> DataFrame:
    """Without blank lines and, unless told otherwise, lines that start with ``#``."""
    rows = lines.filter(~F.col("value").rlike("^\\s*$"))
    return rows.filter(~F.col("value").startswith("#")) if comments else rows


def read_lines(spark: SparkSession, paths: str | Sequence[str], comments: bool = True) -> DataFrame:
    """Records of one or several text files (also .gz). A last line without an end counts."""
    return keep_records(spark.read.text(paths), comments)


# ---- rewriting before the split -------------------------------------------------------------------------------------

# Month names by number.
MONTHS = {m: f"{i + 1:02d}" for i, m in enumerate(["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"])}


def _months(c: Column) -> Column:
    return reduce(lambda x, kv: F.regexp_replace(x, f"(?i)\\b{kv[0]}[a-z]*\\b", kv[1]), MONTHS.items(), c)


PREFILTERS: dict[str, Callable[[Column], Column]] = {
    "month_day_year": lambda c: F.regexp_replace(c, "\\b(\\d{1,2})/(\\d{1,2})/(\\d{4})\\b", "$3-$1-$2"),
    "day_month_year": lambda c: F.regexp_replace(c, "\\b(\\d{1,2})/(\\d{1,2})/(\\d{4})\\b", "$3-$2-$1"),
    "year_month_day": lambda c: F.regexp_replace(c, "\\b(\\d{4})/(\\d{1,2})/(\\d{1,2})\\b", "$1-$2-$3"),
    "day_monthname_year": lambda c: F.regexp_replace(_months(c), "\\b(\\d{1,2})[ /-](\\d{2})[ /-](\\d{4})[: ]", "$3-$2-$1 "),
    "month_names": _months,
    "strip_quotes": lambda c: F.regexp_replace(c, "[\"']", ""),
    "strip_brackets": lambda c: F.regexp_replace(c, "[\\[\\]]", ""),
}


def prefilter(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    return lines.withColumn("value", reduce(lambda c, n: PREFILTERS[n](c), names, F.col("value")))


# ---- readers --------------------------------------------------------------------------------------------------------


def _fields(lines: DataFrame, cells: Column, types: Sequence[C.ColumnType | None]) -> DataFrame:
    rows = lines.select(cells.alias("_cells"))
    return rows.select(*[t.parsed(F.trim(F.get("_cells", F.lit(i)))).alias(t.name) for i, t in enumerate(types) if t is not None and not isinstance(t, C.PadType)])


def simple(lines: DataFrame, types: Sequence[C.ColumnType | None], delimiter: str = "\\s+", prefilters: Sequence[str] = ()) -> DataFrame:
    """Cells between matches of ``delimiter``; a type of None skips a cell, a missing cell is null."""
    return _fields(prefilter(lines, prefilters), F.split("value", delimiter), types)


def csv(lines: DataFrame, types: Sequence[C.ColumnType | None], delimiter: str = ",") -> DataFrame:
    """Quoted cells with a separator."""
    schema = ", ".join(f"_{i} string" for i in range(len(types)))
    row = F.from_csv("value", schema, {"sep": delimiter})
    return _fields(lines.select(F.array(*[row[f"_{i}"] for i in range(len(types))]).alias("value")), F.col("value"), types)


def matched(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    """``_g``, the groups of a pattern anchored at both ends as an array, of the lines that match. The pattern runs once a line: the line
    is rewritten to its groups with a separator, which other lines don't get."""
    mark = "\u0001"
    rewritten = F.regexp_replace("value", pattern, mark + mark.join(f"${i}" for i in range(1, groups + 1)))
    rows = lines.select(F.split(rewritten, mark).alias("_g")).filter(F.size("_g") == groups + 1)
    return rows.select(F.slice("_g", 2, groups).alias("_g"))


def _groups(lines: DataFrame, pattern: str, types: Sequence[C.ColumnType]) -> DataFrame:
    """One anchored pattern, a group per type; empty groups are null, lines that don't match are left out."""
    got = [(t, F.get("_g", F.lit(i))) for i, t in enumerate(types)]
    return matched(lines, pattern, len(types)).select(*[t.parsed(F.when(g != "", g)).alias(t.name) for t, g in got if not isinstance(t, C.PadType)])


# Named formats of web server logs.
APACHE_FORMATS = {
    "common": '%h %l %u %t "%r" %>s %b',
    "vhost_common": '%v %h %l %u %t "%r" %>s %b',
    "combined": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i"',
    "debian_full": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i" "%{forensic-id}n" %T %v',
    "debian_debug": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i" "%{forensic-id}n" %P %T',
    "debian_combined": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i" "%{forensic-id}n"',
    "debian_forensic": '%h %l %u %t "%r" %>s %b "%{forensic-id}n"',
    "debian_common": '%h %l %u %t "%r" %>s %b',
    "debian_referer": "%{Referer}i -> %U",
    "debian_agent": "%{User-agent}i",
    "referer": "%{Referer}i -> %U",
    "agent": "%{User-agent}i",
}
# Field codes with the column they fill and its type.
APACHE_CODES = {
    "a": ("remote_ip", C.IPType), "A": ("local_ip", C.IPType), "B": ("size", C.BigIntegerType), "b": ("size", C.BigIntegerType), "C": ("cookie", C.StringType), "D": ("microseconds", C.BigIntegerType),
    "e": ("environment", C.StringType), "f": ("filename", C.StringType), "h": ("rhost", C.IPType), "H": ("protocol", C.StringType), "i": ("header", C.StringType), "I": ("bytes_in", C.BigIntegerType),
    "k": ("keepalives", C.IntegerType), "l": ("rlogname", C.StringType), "L": ("log_id", C.StringType), "m": ("method", C.StringType), "n": ("note", C.StringType), "o": ("reply_header", C.StringType),
    "O": ("bytes_out", C.BigIntegerType), "p": ("port", C.IntegerType), "P": ("pid", C.IntegerType), "q": ("query", C.StringType), "r": ("request", C.StringType), "R": ("handler", C.StringType),
    "s": ("status", C.IntegerType), "S": ("bytes_both", C.BigIntegerType), "t": ("time", C.TimestampType), "T": ("seconds", C.IntegerType), "u": ("ruser", C.StringType), "U": ("path", C.StringType), "v": ("server", C.StringType),
    "V": ("canonical_server", C.StringType), "X": ("connection_status", C.StringType),
}


def apache_pattern(form: str) -> tuple[str, list[C.ColumnType]]:
    """The regular expression and columns of a format text or of the name of a known one."""
    form = APACHE_FORMATS.get(form, form)
    out, types, at = [], [], 0
    for m in re.finditer(r"%[<>!0-9,]*(?:\{([^}]*)\})?([a-zA-Z])", form):
        out.append(re.escape(form[at : m.start()]).replace("\\ ", " "))
        name, kind = APACHE_CODES[m.group(2)]
        if m.group(1):
            name = re.sub("[^a-z0-9]", "_", m.group(1).lower())
        quoted = form[m.start() - 1 : m.start()] == '"'
        if kind is C.TimestampType:
            out.append(r"\[([^\]]*)\]")
            types.append(C.TimestampType(name, form="dd/MMM/yyyy:HH:mm:ss Z"))
        elif m.group(2) == "r":
            out.append(r"(\S+) (.*?)(?: (HTTP/[\d.]+))?")
            types += [C.StringType("method"), C.StringType("request"), C.StringType("protocol")]
        else:
            out.append(r'((?:[^"\\]|\\.)*)' if quoted else r"(\S*)")
            types.append(kind(name))
        at = m.end()
    out.append(re.escape(form[at:]).replace("\\ ", " "))
    return "^" + "".join(out) + "$", types


def apache(lines: DataFrame, form: str = "combined") -> DataFrame:
    """A web server log of any format text; ``-`` is null; the time is in UTC."""
    pattern, types = apache_pattern(form)
    rows = _groups(lines, pattern, [C.StringType(t.name) for t in types])
    out = []
    for t in types:
        c = F.when(F.col(t.name) != "-", F.col(t.name))
        out.append(t.parsed(c).alias(t.name))
    return rows.select(*out)


def iis_schema(header: str) -> list[C.ColumnType]:
    """Column types of a ``#Fields:`` line: names say what is an address, a status or a size."""
    names = [re.sub("[^a-z0-9]+", "_", n.lower()).strip("_") for n in header.split(":", 1)[1].split()]
    return [C.IPType(n) if n.endswith("_ip") else C.IntegerType(n) if n.endswith("_status") or n == "status" else C.BigIntegerType(n) if n.endswith("bytes") else C.StringType(n) for n in names]


MAX_HEADERS = 1000


def w3c_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files with ``file``, ``at`` (the block they were read in) and ``n`` (a number that grows within a block)."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))


def iis_sections(lines: DataFrame) -> DataFrame:
    """W3C logs of several files as :func:`w3c_lines` gives them, each line read under the last ``#Fields:`` line before it in its
    file; lines without one are left out. Columns that only some headers have are null elsewhere."""
    is_head = F.col("value").startswith("#Fields:")
    heads = [r[0] for r in lines.filter(is_head).select("value").distinct().orderBy("value").limit(MAX_HEADERS + 1).collect()]
    if len(heads) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    if not heads:
        raise ValueError("a W3C log needs a #Fields: line")
    placed = running(lines.select("value", "file", "at", "n"), "file", "at", {"_head": ("before", F.when(is_head, F.struct("at", "n", "value")))}, ties=("n",))
    parts = [iis(placed.filter(F.col("_head.value") == h).select("value"), h) for h in heads]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def iis(lines: DataFrame, header: str | None = None) -> DataFrame:
    """A W3C log; date and time become ``timestamp``. The header is the first ``#Fields:`` line if not given: for one file with one
    header; :func:`iis_sections` reads several."""
    if header is None:
        first = lines.filter(F.col("value").startswith("#Fields:")).select("value").first()
        if first is None:
            raise ValueError("a W3C log needs a #Fields: line")
        header = first[0]
    types = iis_schema(header)
    rows = _fields(keep_records(lines), F.split("value", " +"), [C.StringType(t.name) for t in types])
    rest = [t.parsed(F.when(F.col(t.name) != "-", F.col(t.name))).alias(t.name) for t in types if t.name not in ("date", "time")]
    names = {t.name for t in types}
    stamp = [F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp")] if {"date", "time"} <= names else []
    return rows.select(*stamp, *rest)


def syslog(lines: DataFrame, year: int = 2007) -> DataFrame:
    """``Mon dd HH:MM:SS host service message``; the year, which the lines lack, is given."""
    pattern = r"^([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) (\S+) ([^ :\[]+)(?:\[\d+\])?:? (.*)$"
    rows = matched(lines, pattern, 4)
    g = [F.get("_g", F.lit(i)) for i in range(4)]
    return rows.select(dates.with_year(g[0], "MMM d HH:mm:ss", year).alias("timestamp"), g[1].alias("hostname"), g[2].alias("service"), g[3].alias("message"))


# Keys of a packet filter's lines.
IPTABLES_TEXT = ["IN", "OUT", "MAC", "PROTO"]
IPTABLES_IP = ["SRC", "DST"]
IPTABLES_INT = ["LEN", "TOS", "TTL", "ID", "SPT", "DPT", "TYPE", "CODE", "SEQ", "WINDOW", "RES"]


def iptables(lines: DataFrame, year: int = 2007) -> DataFrame:
    """KEY=VALUE lines of a packet filter with time and action; lines with fewer than three keys are left out. The first value
    of a key holds."""
    every = IPTABLES_TEXT + IPTABLES_IP + IPTABLES_INT
    rows = lines.filter(F.regexp_count("value", F.lit(f"(?:^| )(?:{'|'.join(every)})=")) > 2)
    filled = lambda k: F.nullif(F.regexp_extract("value", f"(?:^| ){k}=([^ ]*)", 1), F.lit(""))

    def number(c: Column) -> Column:
        return F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(c).try_cast("bigint")

    named = rows.select("value", *[filled(k).alias(k) for k in every])
    head = F.split(F.regexp_replace("value", r"^([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) .*?kernel: (?:\[[^\]]*\] )?([^=]*?) ?[A-Z]+=.*$", "$1\u0001$2"), "\u0001")
    stamp = dates.with_year(F.get(head, F.lit(0)), "MMM d HH:mm:ss", year)
    return named.select(stamp.alias("time"), F.trim(F.coalesce(F.get(head, F.lit(1)), F.lit(""))).alias("action"), *IPTABLES_TEXT, *[net.ip_to_long(F.col(k)).alias(k) for k in IPTABLES_IP], *[number(F.col(k)).alias(k) for k in IPTABLES_INT])


@dataclass(frozen=True)
class Consumed:
    """One step of the advanced reader: text up to and including ``boundary`` is skipped, then ``pattern`` is read."""

    type: C.ColumnType
    boundary: str = ""
    pattern: str | None = None


def advanced(lines: DataFrame, steps: Sequence[Consumed]) -> DataFrame:
    """Columns read one after the other, each by its own pattern; the steps make one anchored expression."""
    parts = [f"{s.boundary}({s.pattern or s.type.pattern})" for s in steps]
    return _groups(lines, "^" + "".join(parts) + ".*$", [s.type for s in steps])


# Message families of a firewall by the words they hold.
PIX_HEAD = r"^(\S+ +\d+ \d\d:\d\d:\d\d) (\S+) (?:.*?)%PIX-\d-(\d+): (.*)$"


def pix_messages(lines: DataFrame, year: int = 2007) -> DataFrame:
    """timestamp, hostname, code, message of a firewall's lines."""
    rows = matched(lines, PIX_HEAD, 4)
    g = [F.get("_g", F.lit(i)) for i in range(4)]
    return rows.select(dates.with_year(g[0], "MMM d HH:mm:ss", year).alias("timestamp"), g[1].alias("hostname"), g[2].alias("code"), g[3].alias("message"))


def pix_connections(messages: DataFrame) -> DataFrame:
    """Connections out of the message families Built, Teardown, Deny, access-list, and files Stored or Retrieved."""
    m = F.col("message")
    built = r"Built (inbound|outbound) (\w+) connection (\d+) for (\S+):([\d.]+)/(\d+).* to (\S+):([\d.]+)/(\d+)"
    gone = r"Teardown ()(\w+) connection (\d+) (?:for|faddr) (\S+):([\d.]+)/(\d+) to (\S+):([\d.]+)/(\d+)"
    deny = r"Deny ()(\w+)() (?:src|from) (\S+):([\d.]+)/(\d+) (?:dst|to) (\S+):([\d.]+)/(\d+)"
    listed = r"access-list \S+ (permitted|denied) (\w+)() (\S+)/([\d.]+)\((\d+)\) -> (\S+)/([\d.]+)\((\d+)\)"
    moved = r"^()()()()([\d.]+)() (Stored|Retrieved) ([\d.]+):(.*)$"
    family = F.when(m.rlike(moved), F.regexp_extract(m, moved, 7)).when(m.rlike(built), "Built").when(m.rlike(gone), "Teardown").when(m.rlike(deny), "Deny").when(m.rlike(listed), F.concat(F.lit("access-list "), F.regexp_extract(m, listed, 1)))

    def g(i: int) -> Column:
        pick = F.when(family.isin("Stored", "Retrieved"), F.regexp_extract(m, moved, {5: 5, 8: 8}.get(i, 1))).when(family == "Built", F.regexp_extract(m, built, i)).when(family == "Teardown", F.regexp_extract(m, gone, i)).when(family == "Deny", F.regexp_extract(m, deny, i)).otherwise(F.regexp_extract(m, listed, i))
        return F.when(pick != "", pick)

    return messages.filter(family.isNotNull()).select(
        "timestamp", family.alias("action"), F.when(family == "Built", g(1)).alias("direction"), g(2).alias("protocol"), g(3).try_cast("bigint").alias("conn_number"),
        g(4).alias("src_if"), net.ip_to_long(g(5)).alias("src_host"), g(6).try_cast("int").alias("src_port"), g(7).alias("dst_if"), net.ip_to_long(g(8)).alias("dst_host"), g(9).try_cast("int").alias("dst_port"),
        F.regexp_extract(m, r"duration (\S+)", 1).alias("duration"), F.regexp_extract(m, r"bytes (\d+)", 1).try_cast("bigint").alias("bytes"),
    )


def repeated(rows: DataFrame, key: str, order: str, times: str) -> DataFrame:
    """A row followed by a "repeated n" row stands for 1 + n rows. ``times`` is n on repeat rows and null on others; a repeat
    without a row before it in its ``key`` stands for nothing. ``order`` is a number. Adds ``copy``, from 0."""
    back = running(rows.withColumn("_back", -F.col(order)), key, "_back", {"_next": ("before", F.struct("_back", F.col(times).alias("n")))})
    kept = back.filter(F.col(times).isNull()).withColumn("_n", F.coalesce("_next.n", F.lit(0)))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n")))).drop("_n", "_next", "_back")


def load(rows: DataFrame, types: Mapping[str, C.ColumnType], text: str = "", limit: int | None = None) -> DataFrame:
    """Typed rows through a load-time filter, exactly ``limit`` of them for a trial."""
    out = rows.filter(filterlang.to_column(filterlang.parse(text), types))
    return out if limit is None else out.limit(limit)


# ---- presets --------------------------------------------------------------------------------------------------------

READERS = {"simple": simple, "csv": csv, "apache": apache, "iis": iis, "syslog": syslog, "iptables": iptables}


@dataclass(frozen=True)
class Preset:
    """A reader with its options, stored as JSON. ``fields`` are (column type name, column name), empty for a skipped cell."""

    name: str
    reader: str
    fields: list[tuple[str, str]] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({"name": self.name, "reader": self.reader, "fields": self.fields, "options": self.options})

    @staticmethod
    def loads(text: str) -> Preset:
        d = json.loads(text)
        return Preset(d["name"], d["reader"], [tuple(x) for x in d["fields"]], d["options"])

    def read(self, lines: DataFrame) -> DataFrame:
        if self.reader in ("simple", "csv"):
            types = [getattr(C, kind)(name) if kind else None for kind, name in self.fields]
            return READERS[self.reader](lines, types, **self.options)
        return READERS[self.reader](lines, **self.options)


class Presets:
    """Named presets of a case, and the tables that were loaded with them."""

    def __init__(self) -> None:
        self.presets: dict[str, str] = {}
        self.tables: dict[str, str] = {}

    def save(self, preset: Preset) -> None:
        self.presets[preset.name] = preset.dumps()

    def restore(self, name: str) -> Preset:
        return Preset.loads(self.presets[name])

    def loaded(self, name: str) -> list[str]:
        return sorted(t for t, p in self.tables.items() if p == name)

    def load_table(self, name: str, table: str, lines: DataFrame) -> str:
        """Saves the rows as ``<table>_log`` in the session's current database."""
        self.restore(name).read(lines).write.mode("overwrite").saveAsTable(f"{table}_log")
        self.tables[table] = name
        return f"{table}_log"

    def drop(self, spark: SparkSession, name: str) -> None:
        """The preset and every table loaded with it."""
        for t in self.loaded(name):
            spark.sql(f"DROP TABLE IF EXISTS `{t}_log`")
            del self.tables[t]
        self.presets.pop(name, None)
