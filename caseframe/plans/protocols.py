"""Protocol streams and record files (E, S11), graph closure (J17) and dumps (X25, X26) over the given tables."""

from __future__ import annotations

import struct
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe import query as Q
from caseframe.functions import text
from caseframe.operators import flows, lookup, protocols, scanners
from caseframe.plans import joins
from caseframe.plans.registry import query, relation
from caseframe.plans.scans import _made
from caseframe.session import load


@query("select inode_id * 2 as inode_id, n, method, concat(url, '&n=', cast(n as string)) as url, host, case when n = 0 then status end as status from http, (values (0), (1)) v(n)", "http")
def E14_exchanges(spark, d):
    """Two requests on each stream, the first of which is answered after an informational response."""
    h = relation(spark, d, "http")
    path = F.regexp_replace("url", "^http://[^/]*", "")
    ask = lambda n: F.concat("method", F.lit(" "), path, F.lit(f"&n={n} HTTP/1.1\r\nHost: "), "host", F.lit("\r\nContent-Length: 0\r\n\r\n"))
    told = F.concat(F.lit("HTTP/1.1 100 Continue\r\nContent-Length: 0\r\n\r\nHTTP/1.1 "), F.col("status").cast("string"), F.lit(" Said\r\nContent-Length: 2\r\n\r\nok"))
    streams = h.select((F.col("inode_id") * 2).alias("inode_id"), F.concat(ask(0), ask(1)).alias("content")).unionByName(h.select((F.col("inode_id") * 2 + 1).alias("inode_id"), told.alias("content")))
    pairs = h.select((F.col("inode_id") * 2).alias("inode_id"), (F.col("inode_id") * 2 + 1).alias("reverse"))
    return protocols.exchanges(streams, pairs).select("inode_id", "n", "method", "url", "host", "status")


@query("""select inode_id, s as source, k as name, v as value from (
  select inode_id, 'query' as s, 'q' as k, concat(event_type, ' ', cast(user_id as string)) as v from e
  union all select inode_id, 'query', 'page', cast(inode_id as string) from e
  union all select inode_id, 'body', 'b&c', event_type from e
  union all select inode_id, 'body', 'empty', '' from e
  union all select inode_id, 'cookie', 'sid', cast(user_id as string) from e)""".replace("from e", "from (select event_id as inode_id, event_type, user_id from events)"))
def E14_parameters(spark, d):
    """Parameters of the query, of a form body and of cookies; every third body is of several parts."""
    e = load(spark, d, "events")
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    part = lambda name, value: F.concat(F.lit(f'--X\r\nContent-Disposition: form-data; name="{name}"\r\n\r\n'), value, F.lit("\r\n"))
    many = F.concat(part("b&c", F.col("event_type")), part("empty", F.lit("")), F.lit("--X--\r\n"))
    form = F.concat(F.lit("b%26c="), "event_type", F.lit("&empty="))
    body = F.when(F.col("event_id") % 3 == 0, many).otherwise(form)
    kind = F.when(F.col("event_id") % 3 == 0, "multipart/form-data; boundary=X").otherwise("application/x-www-form-urlencoded")
    content = F.concat(F.lit("POST /?q="), "event_type", F.lit("+"), user, F.lit("&page="), number, F.lit(" HTTP/1.1\r\nHost: h\r\nCookie: sid="), user, F.lit("\r\nContent-Type: "), kind, F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body)
    return scanners.scan(e.select(F.col("event_id").alias("inode_id"), content.alias("content")), protocols.http_parameters, protocols.PARAMETER).select("inode_id", "source", "name", "value")


def _control():
    """The control stream of a session; a null leaves its line out, line ends in texts become spaces."""
    one = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, "[\\r\\n]+", " ")), "^$", "-")
    line = lambda head, c: F.coalesce(F.concat(F.lit(head), one(F.col(c)), F.lit("\r\n")), F.lit(""))
    return F.concat(line("220 ", "server_banner"), line("USER ", "username"), F.lit("331 go on\r\n"), line("pass ", "password"), line("230 ", "welcome_banner"), F.lit("QUIT\r\n221 bye\r\n"))


@query("""select distinct inode_id, case when username is null then null else u end as username, p as password, b as server_banner, w as welcome_banner from (
  select inode_id, username, regexp_replace(trim(regexp_replace(username, '[\\r\\n]+', ' ', 'g')), '^$', '-') as u, regexp_replace(trim(regexp_replace(password, '[\\r\\n]+', ' ', 'g')), '^$', '-') as p,
    regexp_replace(trim(regexp_replace(server_banner, '[\\r\\n]+', ' ', 'g')), '^$', '-') as b, regexp_replace(trim(regexp_replace(welcome_banner, '[\\r\\n]+', ' ', 'g')), '^$', '-') as w from ftp_sessions)
where b is not null""")
def E16_ftp_sessions(spark, d):
    """Sessions read back from control streams; one whose banner isn't known has a stream that starts with a reply to nothing."""
    s = load(spark, d, "ftp_sessions").filter("server_banner is not null").select("inode_id", "username", "password", "server_banner", "welcome_banner").distinct()
    # Several records of one session are several streams.
    keyed = s.withColumn("key", F.xxhash64(*s.columns))
    lines = scanners.scan(keyed.select(F.col("key").alias("inode_id"), F.encode(_control(), "UTF-8").alias("content")), protocols.ftp_control, protocols.FTP_LINE)
    got = protocols.ftp_sessions(lines).withColumnRenamed("inode_id", "key")
    return keyed.select("key", "inode_id").join(got, "key").drop("key").distinct()


@query("""select event_id as inode_id, concat('user', cast(user_id as string)) as sender, 'PRIVMSG' as command, '#' || event_type as recipient, concat('hello: ', cast(event_id as string)) as data from events
union all select event_id, null, 'PING', null, 'server' from events""")
def E16_irc(spark, d):
    e = load(spark, d, "events")
    nick = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    content = F.concat(F.lit(":"), nick, F.lit("!me@host privmsg #"), "event_type", F.lit(" :hello: "), F.col("event_id").cast("string"), F.lit("\r\nPING :server\r\n"))
    return scanners.scan(e.select(F.col("event_id").alias("inode_id"), content.alias("content")), protocols.irc, protocols.IRC).select("inode_id", "sender", "command", "recipient", "data")


def _event_record(i, c) -> bytes:
    at, kind, user = c.split("|")
    wide = lambda s: s.encode("utf-16-le") + b"\0\0"
    names = wide("app") + wide("host")
    strings = wide(kind) + wide(user)
    size = 56 + len(names) + len(strings) + 4
    head = struct.pack("<I4sIIIIHHHHIIIIII", size, b"LfLe", i & 0xFFFFFFFF, int(at), int(at), 0x40000000 | 17, 4, 2, 0, 0, 0, 56 + len(names), 0, 0, 0, 0)
    return b"\0" * 48 + head + names + strings + struct.pack("<I", size) + head[:20]


@query("select event_id as inode_id, event_id as record, date_trunc('second', ts) as time, cast(17 as bigint) as event, 'app' as source, event_type as arg1, cast(user_id as string) as arg2 from events")
def S11_event_records(spark, d):
    """Records of event log files, each followed by a torn one."""
    e = load(spark, d, "events").select(F.col("event_id").alias("inode_id"), F.concat_ws("|", F.unix_timestamp("ts").cast("string"), "event_type", F.col("user_id").cast("string")).alias("content"))
    rows = scanners.scan(_made(e, _event_record), protocols.event_log, protocols.EVENT)
    return rows.select("inode_id", "record", F.col("time").cast("timestamp_ntz").alias("time"), "event", "source", F.get("args", F.lit(0)).alias("arg1"), F.get("args", F.lit(1)).alias("arg2"))


def _history_record(i, c) -> bytes:
    at, url = c.split("|", 1)
    ticks = (int(at) + 11_644_473_600) * 10_000_000
    url_at, name_at = 0x60, 0x60 + len(url) + 1
    heads_at, heads = name_at + 6, b"HTTP/1.1 200 OK\r\n"
    size = -(-(heads_at + len(heads)) // 128)
    body = bytearray(size * 128)
    struct.pack_into("<4sIQQ", body, 0, b"URL ", size, ticks, ticks + 10_000_000)
    for x, v in ((0x34, url_at), (0x3C, name_at), (0x44, heads_at), (0x48, len(heads))):
        struct.pack_into("<I", body, x, v)
    body[url_at : url_at + len(url)] = url.encode()
    body[name_at : name_at + 5] = b"f[1]."
    body[heads_at : heads_at + len(heads)] = heads
    return b"Client UrlCache MMF Ver 5.2".ljust(128, b"\0") + bytes(body)


@query("select inode_id, cast(128 as bigint) as \"offset\", url, date_trunc('second', date) as modified, date_trunc('second', date) + interval 1 second as accessed, 'f[1].' as filename from http", "http")
def E9_history(spark, d):
    h = relation(spark, d, "http").select("inode_id", F.concat_ws("|", F.unix_timestamp("date").cast("string"), "url").alias("content"))
    rows = scanners.scan(_made(h, _history_record), protocols.history, protocols.HISTORY)
    return rows.select("inode_id", "offset", "url", F.col("modified").cast("timestamp_ntz").alias("modified"), F.col("accessed").cast("timestamp_ntz").alias("accessed"), "filename")


@query("""with recursive s as (select n_name as name, r_name as pname from nation join region on r_regionkey = n_regionkey union all select r_name, 'world' from region),
c as (select name, pname as next from s union select c.name, s.pname from c join s on s.name = c.next) select distinct name, next from c""")
def J17_reach(spark, d):
    """Everything that is reached from each name by any number of steps."""
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("pname"))
    edges = up.unionByName(region.select(F.col("r_name").alias("name"), F.lit("world").alias("pname")))
    return lookup.graph_reach(edges, edges.select("name"))


@query("select doc_id as inode_id, '''' || replace(replace(text, '\\', '\\\\'), '''', '\\''') || '''' as quoted from documents where text is not null")
def X25_quoted(spark, d):
    return load(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("inode_id"), text.quoted(F.col("text")).alias("quoted"))


@query("select doc_id as inode_id, cast(16 * i as bigint) as \"offset\", substr(h, cast(32 * i + 1 as int), 32) as hex from (select doc_id, h, unnest(range(0, (length(h) + 31) // 32)) as i from (select doc_id, hex(encode(text)) as h from documents where text is not null))")
def X26_hex_dump(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("inode_id"), F.explode(text.hex_dump(F.encode("text", "UTF-8"))).alias("r")).select("inode_id", "r.offset", "r.hex")


# ---- distinct lists (A4) and browses (Q11) --------------------------------------------------------------------------

LISTS = {
    "A4_mime": ("type", "mime"),
    "A4_kinds": ("type", "type"),
    "A4_hosts": ("http", "host"),
    "A4_methods": ("http", "method"),
    "A4_statuses": ("http", "status"),
    "A4_ports": ("connection_details", "dest_port"),
    "A4_word_types": ("word", "word_type"),
    "A4_commands": ("command", "command_type"),
    "A4_notes": ("annotate", "note"),
}


def _list(name: str, table: str, column: str):
    def values(spark, d):
        """Values of one column for a choice; they are combined in each task before they are moved."""
        return relation(spark, d, table).select(column).distinct()

    values.__name__ = name
    query(f"select distinct {column} from {table}", table)(values)


for _name, (_table, _column) in LISTS.items():
    _list(_name, _table, _column)


@query("select c.inode_id, c.ftp_session_id, c.command_type, c.command, s.username from command c join (select inode_id, min(username) as username from session group by 1) s on s.inode_id = c.ftp_session_id where c.command_type = 'reverse'", "command", "session")
def Q11_browse_ftp(spark, d):
    s = relation(spark, d, "session").groupBy(F.col("inode_id").alias("ftp_session_id")).agg(F.min("username").alias("username"))
    cols = [C.BigIntegerType("inode_id", table="command"), C.BigIntegerType("ftp_session_id", table="command"), C.StringType("command_type", table="command"), C.StringType("command", table="command"), C.StringType("username", table="session")]
    return Q.run(Q.QuerySpec(cols, "command_type = reverse", order=None, key="ftp_session_id"), {"command": relation(spark, d, "command").select("inode_id", "ftp_session_id", "command_type", "command"), "session": s})


@query("select t.inode_id, t.mime, t.type, i.status, i.size from type t join inode i using (inode_id) where t.type ilike '%html%'", "type", "inode")
def Q11_browse_types(spark, d):
    cols = [C.BigIntegerType("inode_id", table="type"), C.StringType("mime", table="type"), C.StringType("type", table="type"), C.StringType("status", table="inode"), C.BigIntegerType("size", table="inode")]
    return Q.run(Q.QuerySpec(cols, "type contains html", order=None), {"type": relation(spark, d, "type"), "inode": relation(spark, d, "inode").select("inode_id", "status", "size")})


@query("select f.name, upper(md5(d.text)) as md5, octet_length(encode(d.text)) as size from documents d join file f on f.inode_id = d.doc_id where octet_length(encode(d.text)) >= 16 and f.status = 'deleted'", "file")
def Q11_browse_digests(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("inode_id"), "text")
    known = scanners.digests(docs, "inode_id", "text").join(docs.select("inode_id", F.octet_length("text").alias("size")), "inode_id")
    return known.join(relation(spark, d, "file").filter("status = 'deleted'").select("inode_id", "name"), "inode_id").select("name", "md5", "size")


@query("select id, netname, country, descr from whois where country = 'XB' and netname is not null")
def Q11_browse_whois(spark, d):
    cols = [C.IntegerType("id"), C.StringType("netname"), C.StringType("country"), C.StringType("descr")]
    return Q.run(Q.QuerySpec(cols, "country = XB", order=None), {"whois": load(spark, d, "whois").filter("country = 'XB' and netname is not null")})


@query("select inode_id, sender, recipient, data from (select event_id as inode_id, concat('user', cast(user_id as string)) as sender, '#' || event_type as recipient, concat('hello: ', cast(event_id as string)) as data from events) where recipient = '#error'")
def Q11_browse_irc(spark, d):
    cols = [C.BigIntegerType("inode_id"), C.StringType("sender"), C.StringType("recipient"), C.StringType("data")]
    return Q.run(Q.QuerySpec(cols, 'recipient = "#error"', order=None), {"irc": E16_irc(spark, d).select("inode_id", "sender", "recipient", "data")})


@query("""select 'http' as what, count(*) as n from http union all select 'irc', count(*) from events union all select 'ftp', count(*) from command union all select 'mail', count(*) from documents where kind = 'mail'""", "http", "command")
def A15_protocol_counts(spark, d):
    """Counts per protocol, each from its own table."""
    docs = load(spark, d, "documents").filter("kind = 'mail'")
    each = {"http": relation(spark, d, "http"), "irc": load(spark, d, "events"), "ftp": relation(spark, d, "command"), "mail": docs}
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, t in each.items()])


@query("""select m.event_id as message_id, h.inode_id from events m join http h on contains(h.url, concat('page=', cast(m.event_id as string))) and h.host = concat('www.site', cast(m.user_id as string), case when m.user_id < 50 then '.com.au' when m.user_id < 100 then '.example.org' else '.co.uk' end) where m.event_type = 'signup'""", "http")
def J15_message_requests(spark, d):
    """Messages with the requests whose address contains their id: a containment test within the equal host, never all with all."""
    h = relation(spark, d, "http").select("inode_id", "host", "url")
    m = relation(spark, d, "http").filter("content_type = 'video/mpeg'").select(F.col("inode_id").alias("message_id"), "host", F.concat(F.lit("page="), F.col("inode_id").cast("string")).alias("_part"))
    return lookup.containing(h, "url", m, "_part", "host").select("message_id", "inode_id")


@query("select user_id as stream, session, array_to_string(list(event_type order by event_id), ',') as parts from (select *, cast(sum(case when g is null or g > 2000 then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as session from (select *, event_id - lag(event_id) over (partition by user_id order by event_id) as g from events)) group by 1, 2")
def T7_datagram_order(spark, d):
    """Datagrams of each session in order of arrival."""
    rows = flows.datagrams(joins._segments(spark, d))
    return rows.select("stream", "session", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query("""select stream, session, sum(new)::bigint as bytes, max(stop) - min(seq) as span from (
  select *, greatest(seq + n - greatest(seq, coalesce(seen, seq)), 0) as new, seq + n as stop from (
    select *, max(seq + n) over (partition by stream, session order by seq, id rows between unbounded preceding and 1 preceding) as seen from (
      select user_id as stream, event_id as id, cast(floor(value * 3) as bigint) as seq, length(event_type) as n, cast(sum(case when g is null or g > 2000 then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as session
      from (select *, event_id - lag(event_id) over (partition by user_id order by event_id) as g from events)))) group by 1, 2""")
def T2_reassembled_bytes(spark, d):
    """Bytes that segments added to their stream, and the bytes that content and gaps span: what reassembly must give."""
    got = flows.reassembled(joins._segments(spark, d))
    events = F.filter("events", lambda x: x.endswith(":data"))
    missing = F.aggregate(F.transform("gaps", lambda g: g["length"]), F.lit(0).cast("long"), lambda a, x: a + x)
    span = (F.octet_length("content") + missing).alias("span")
    # Every byte that was sent is a letter, what fills gaps is zero.
    kept = F.octet_length("content") - (F.length(F.decode("content", "ISO-8859-1")) - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\0"), F.lit(""))))
    return got.filter(F.size(events) > 0).select("stream", "session", kept.cast("long").alias("bytes"), span.cast("long").alias("span"))
