"""Keyword index (I), scanners (E, M), binary and incremental sources, and the remaining canned queries."""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe import query as Q
from caseframe.functions import net, text
from caseframe.operators import analytics, flows, hierarchy, index, lookup, scanners
from caseframe.plans import joins
from caseframe.plans.registry import QUERIES, SQL, query, relation
from caseframe.session import ensure_checkpoint_dir, load
from caseframe.sources import listing, reference
from caseframe.streaming import flows as stream_flows
from caseframe.streaming import ingest

# Words that the scans over documents look for: (id, word, kind).
WORDS = [(1, "the", "word"), (2, "here", "word"), (3, "there", "word"), (4, "HER", "literal"), (5, "Re", "literal"), (6, "report", "word"), (1 << 30 | 7, "ion", "word")]


def _dictionary(spark, entries=WORDS) -> DataFrame:
    return spark.createDataFrame([(i, w, k, "English") for i, w, k in entries], "word_id long, word string, word_type string, class string")


def _documents(spark, d) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("inode_id"), F.col("text").alias("content"))


_VALUES = ", ".join(f"({i}, '{w}', '{k}')" for i, w, k in WORDS)
_HITS = f"""with w(word_id, word, kind) as (values {_VALUES}), t as (select doc_id as inode_id, text from documents where text is not null and text <> ''),
p as (select inode_id, w.word_id, length(w.word) as n, string_split(case w.kind when 'word' then lower(text) else text end, case w.kind when 'word' then lower(w.word) else w.word end) as parts from t, w),
h as (select inode_id, cast(word_id as bigint) as word_id, n as "length", unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::bigint + (i - 1) * n)) as "offset" from p) """


@query(_HITS + 'select inode_id, word_id, "offset", cast("length" as int) as "length" from h')
def I1_all_hits(spark, d):
    return index.scan(_documents(spark, d), _dictionary(spark))


# Length in UTF-16 units: characters beyond the first plane take two.
_UNITS = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"


@query(_HITS + f"""select h.inode_id, word_id, 2 * ({_UNITS.format('substr(t.text, 1, h."offset")')}) as "offset", cast(2 * "length" as int) as "length" from h join t on t.inode_id = h.inode_id
where word_id in (select word_id from w where kind = 'word')""")
def I1_wide_content(spark, d):
    """The words in content of two bytes a character: offsets and lengths in bytes."""
    docs = _documents(spark, d).select("inode_id", F.encode("content", "UTF-16LE").alias("content"))
    return index.scan(docs, _dictionary(spark))


@query(_HITS + "select word_id, count(*) as hits, count(distinct inode_id) as inodes from h where word_id in (1, 4, 5) group by 1")
def I2_word_kinds(spark, d):
    hits = index.scan(_documents(spark, d), _dictionary(spark, [x for x in WORDS if x[0] in (1, 4, 5)]))
    return hits.groupBy("word_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("inode_id").alias("inodes"))


@query("""select doc_id as inode_id, count(*) as hits from (select doc_id, substr(text, unnest(range(1, length(text) + 1)), 5) as s from documents where text is not null and text <> '') where regexp_matches(s, '^[0-9][0-9]:[0-9][0-9]$') group by 1""")
def I3_patterns(spark, d):
    hits = index.scan(_documents(spark, d), _dictionary(spark, [(9, "[0-9][0-9]{1,1}:[0-9]{2,2}", "regex")]))
    return hits.groupBy("inode_id").agg(F.count(F.lit(1)).alias("hits"))


@query(_HITS + f'select inode_id, word_id, "offset" from h where word_id >= {1 << 30} union all select inode_id, word_id, min("offset") from h where word_id < {1 << 30} group by 1, 2')
def I4_unique(spark, d):
    return index.unique(index.scan(_documents(spark, d), _dictionary(spark))).select("inode_id", "word_id", "offset")


@query("select p_partkey as word_id, e as encoding, n as bytes from (select p_partkey, 'utf-8' as e, octet_length(encode(lower(p_name))) as n from part union all select p_partkey, 'utf-16', 2 * length(p_name) from part) where n >= 3")
def I5_expanded(spark, d):
    words = load(spark, d, "part").select(F.col("p_partkey").alias("word_id"), F.col("p_name").alias("word"), F.lit("word").alias("word_type"))
    return index.expanded(words).select("word_id", "encoding", F.octet_length("entry").cast("long").alias("bytes"))


@query("select inode_id, max(word_id) as version from hit group by 1 having coalesce(max(word_id), 0) < (select max(word_id) from word)", "hit", "word")
def I6_stale(spark, d):
    versions = relation(spark, d, "hit").groupBy("inode_id").agg(F.max("word_id").alias("version"))
    return index.stale(versions, "version", relation(spark, d, "word"))


@query("select inode_id, word_id, pos as \"offset\" from hit where pos between 1000 and 5000", "hit")
def I7_listed(spark, d):
    return index.listed(relation(spark, d, "hit").select("inode_id", "word_id", F.col("pos").alias("offset")), 1000, 5000)


@query("select cast(p_partkey as bigint) as word_id, p_name as word from part union all select (select max(p_partkey) from part) + 1, 'brand new'")
def I8_added(spark, d):
    words = load(spark, d, "part").select(F.col("p_partkey").alias("word_id"), F.col("p_name").alias("word"), F.lit("word").alias("word_type"), F.lit("English").alias("class"))
    known = words.select("word").first()[0]
    return index.with_words(words, ["brand new", known]).select("word_id", "word")


@query("""select t.inode_id, t.type, h.word_id, h.pos as "offset" from type t join (select inode_id, word_id, pos from (select *, row_number() over (partition by inode_id order by pos, word_id) as k from hit where word_id is not null) where k = 1) h using (inode_id)
where h.word_id in (select word_id from word)""", "type", "hit", "word")
def I9_keyword_column(spark, d):
    hits = relation(spark, d, "hit").select("inode_id", "word_id", F.col("pos").alias("offset"))
    words = relation(spark, d, "word").select("word_id", F.col("class").alias("word"))
    return index.keyword_column(relation(spark, d, "type"), hits, words).select("inode_id", "type", "word_id", "offset")


@query(_HITS + "select word_id, cast(count(*) as bigint) as hits from h group by 1")
def E4_index_scan(spark, d):
    return index.scan(_documents(spark, d), _dictionary(spark)).groupBy("word_id").agg(F.count(F.lit(1)).alias("hits"))


@query(_HITS + "select inode_id, \"offset\", substr(text, greatest(\"offset\" - 20, 0) + 1, \"offset\" - greatest(\"offset\" - 20, 0) + 6 + 50) as preview from (select h.*, t.text from h join t using (inode_id) where word_id = 6)")
def Q17_hits_with_preview(spark, d):
    docs = _documents(spark, d)
    hits = index.scan(docs, _dictionary(spark, [x for x in WORDS if x[0] == 6]))
    return hits.join(docs, "inode_id").select("inode_id", "offset", text.preview(F.col("content"), F.col("offset"), F.col("length")).alias("preview"))


# ---- scanners -------------------------------------------------------------------------------------------------------


def _magic_sql() -> str:
    types: dict[str, list[str]] = {scanners.BASE[0]: [str(scanners.BASE[2])]}
    mime = {scanners.BASE[0]: scanners.BASE[1]}
    for name, m, low, high, pattern, score in scanners.MAGIC:
        p = "'" + pattern.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        types.setdefault(name, []).append(f"case when contains(substr(substr(text, 1, 2048), {low + 1}, {high - low + len(pattern)}), {p}) then {score} else 0 end")
        mime[name] = m
    rows = " union all ".join(f"select doc_id, '{n}' as type, '{mime[n]}' as mime, {' + '.join(s)} as score from documents where text is not null" for n, s in types.items())
    return f"select doc_id as inode_id, type, mime, score from (select *, row_number() over (partition by doc_id order by score desc, type) as k from ({rows})) where k = 1"


@query(_magic_sql())
def M1_magic(spark, d):
    return scanners.magic_scores(_documents(spark, d), "inode_id", "content")


@query(f"select type, count(*) as n from ({_magic_sql()}) group by 1")
def E1_types(spark, d):
    return scanners.magic_scores(_documents(spark, d), "inode_id", "content").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id as inode_id, upper(md5(text)) as md5, coalesce((select min(lang) from documents k where k.kind = 'chat' and octet_length(encode(k.text)) >= 16 and md5(k.text) = md5(t.text)), '-') as product from documents t where octet_length(encode(text)) >= 16")
def E2_digests(spark, d):
    chats = load(spark, d, "documents").filter("kind = 'chat'").filter(F.octet_length("text") >= 16).select(F.upper(F.md5("text")).alias("md5"), F.col("lang").alias("product"))
    return scanners.digests(_documents(spark, d), "inode_id", "content", chats)


def _made(df: DataFrame, make) -> DataFrame:
    """Objects whose bytes ``make`` builds of (inode_id, content): what the scanners then read."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"inode_id": b["inode_id"], "content": [make(i, c) for i, c in zip(b["inode_id"], b["content"])]})

    return df.mapInPandas(run, "inode_id long, content binary")


def _zip(name: str, raw: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, raw)
    return out.getvalue()


@query("select doc_id as inode_id, concat('doc', cast(doc_id as string)) as member, md5(text) as md5 from documents where text is not null")
def E5_containers(spark, d):
    objects = _made(_documents(spark, d).filter("content is not null"), lambda i, c: _zip(f"doc{i}", c.encode()))
    return scanners.scan(objects, scanners.container, scanners.MEMBER).select("inode_id", "member", F.md5("content").alias("md5"))


@query("select doc_id as inode_id, 2 as level, md5(text) as md5 from documents where text is not null union all select doc_id, 1, null from documents where text is not null")
def E5_nested(spark, d):
    objects = _made(_documents(spark, d).filter("content is not null"), lambda i, c: gzip.compress(_zip("x", c.encode()), mtime=0))
    rows = scanners.scan_nested(objects)
    return rows.select("inode_id", "level", F.when(F.col("level") == 2, F.md5("content")).alias("md5"))


@query()
def E6_mail(spark, d):
    mails = load(spark, d, "documents").filter("kind = 'mail'").select(F.col("doc_id").alias("inode_id"), F.encode("text", "UTF-8").alias("content"))
    return scanners.scan(mails, scanners.mail, scanners.MAIL)


def _database(i, c) -> bytes:
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("create table visit (id integer, what text)")
    db.executemany("insert into visit values (?, ?)", [(i, c), (i + 1, None)])
    db.commit()
    return db.serialize()


@query("select s_suppkey as inode_id, 'visit' as tbl, cast(s_suppkey as string) as id, s_name as what from supplier union all select s_suppkey, 'visit', cast(s_suppkey + 1 as string), null from supplier")
def E11_sqlite(spark, d):
    objects = _made(load(spark, d, "supplier").select(F.col("s_suppkey").alias("inode_id"), F.col("s_name").alias("content")), _database)
    rows = scanners.scan(objects, scanners.sqlite_rows, scanners.TABLE_ROW)
    return rows.select("inode_id", "tbl", F.col("values")["id"].alias("id"), F.col("values")["what"].alias("what"))


@query("select o_orderkey as inode_id, 'jpeg' as kind, cast(length(o_orderpriority) as bigint) as \"offset\", cast(7 + length(o_orderstatus) as bigint) as \"length\" from orders")
def E13_carved(spark, d):
    mark, end = F.unhex(F.lit("FFD8FF0000")), F.unhex(F.lit("FFD9"))
    content = F.concat(F.encode("o_orderpriority", "UTF-8"), mark, F.encode("o_orderstatus", "UTF-8"), end, F.encode(F.lit("tail"), "UTF-8"))
    objects = load(spark, d, "orders").select(F.col("o_orderkey").alias("inode_id"), content.alias("content"))
    return scanners.scan(objects, scanners.carve, scanners.CARVED)


@query("select inode_id, method, url, cast(null as int) as status from http union all select inode_id, '-', null, status from http", "http")
def E14_http(spark, d):
    h = relation(spark, d, "http")
    path = F.regexp_replace("url", "^http://[^/]*", "")
    request = F.concat("method", F.lit(" "), path, F.lit(" HTTP/1.1\r\nHost: "), "host", F.lit("\r\nContent-Length: 3\r\n\r\nabc"))
    response = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" Said\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"))
    return scanners.scan(h.select("inode_id", F.concat(request, response).alias("content")), scanners.http_messages, scanners.HTTP).select("inode_id", "method", "url", "status")


def _answer(i, name: str) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"
    alias = b"\5alias\0"
    return struct.pack(">HHHHHH", i & 0xFFFF, 0x8180, 1, 2, 0, 0) + labels + b"\0\1\0\1" + b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, len(alias)) + alias + alias + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([10, 0, i >> 8 & 255, i & 255])


@query("select inode_id, 'CNAME' as kind, host as name, 'alias' as target from http union all select inode_id, 'A', 'alias', concat('10.0.', cast((inode_id >> 8) & 255 as string), '.', cast(inode_id & 255 as string)) from http", "http")
def E15_dns(spark, d):
    objects = _made(relation(spark, d, "http").select("inode_id", F.col("host").alias("content")), _answer)
    return scanners.scan(objects, scanners.dns, scanners.DNS)


@query("select inode_id, host as name, concat('10.0.', cast((inode_id >> 8) & 255 as string), '.', cast(inode_id & 255 as string)) as ip from http", "http")
def J18_resolved_alias(spark, d):
    rows = E15_dns(spark, d)
    alias = rows.filter("kind = 'CNAME'").select("inode_id", "name", F.col("target").alias("_t"))
    found = rows.filter("kind = 'A'").select("inode_id", F.col("name").alias("_t"), F.col("target").alias("ip"))
    return alias.join(found, ["inode_id", "_t"]).select("inode_id", "name", "ip")


@query("select upper(command) as command, coalesce(data, '') as argument from command where command is not null and (data is null or not regexp_matches(data, '[^ -~]'))", "command")
def E16_command_streams(spark, d):
    """Commands are case-blind; every row is a stream of one line."""
    c = relation(spark, d, "command").filter("command is not null and (data is null or not data rlike '[^ -~]')")
    objects = c.select("inode_id", F.encode(F.concat_ws(" ", "command", "data"), "UTF-8").alias("content"))
    return scanners.scan(objects, scanners.commands, scanners.LINES).select("command", "argument")


@query("select c_custkey as inode_id, concat('user', cast(c_custkey as string)) as username, c_name as password from customer")
def E16_credentials(spark, d):
    n = load(spark, d, "customer")
    content = F.concat(F.lit("user user"), F.col("c_custkey").cast("string"), F.lit("\r\nPASS "), "c_name", F.lit("\r\nSTAT\r\n"))
    objects = n.select(F.col("c_custkey").alias("inode_id"), F.encode(content, "UTF-8").alias("content"))
    return scanners.credentials(scanners.scan(objects, scanners.commands, scanners.LINES))


@query("select event_id as inode_id, 0 as id, 40 as \"offset\", length(event_type) as \"length\", date_trunc('second', ts) as ts from events")
def S17_capture(spark, d):
    e = load(spark, d, "events").select("event_id", F.concat_ws("|", F.unix_timestamp("ts").cast("string"), "event_type").alias("content"))

    def capture(i, c) -> bytes:
        at, _, data = c.partition("|")
        return b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<IIII", int(at), 0, len(data), len(data)) + data.encode()

    objects = _made(e.withColumnRenamed("event_id", "inode_id"), capture).select(F.col("inode_id").cast("string").alias("file"), "content")
    rows = scanners.scan(objects, scanners.pcap_packets, scanners.PACKET, "file")
    return rows.select(F.col("file").cast("long").alias("inode_id"), F.col("id").cast("int").alias("id"), F.col("offset").cast("int").alias("offset"), F.col("length").cast("long").alias("length"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("select event_id, concat('event ', cast(event_id as string), ' of ', event_type, ' by ', cast(user_id as string)) as message from events")
def S11_event_log(spark, d):
    args = F.array(F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    return load(spark, d, "events").select("event_id", templated(F.lit("event %1 of %2 by %3"), args).alias("message"))


def templated(template, args):
    """A message template with ``%1`` to ``%n`` filled in."""
    return F.aggregate(F.sequence(F.size(args), F.lit(1), F.lit(-1)), template, lambda acc, i: F.replace(acc, F.concat(F.lit("%"), i.cast("string")), F.coalesce(F.element_at(args, i), F.lit(""))))


@query()
def S16_storage_listing(spark, d):
    return listing.storage(spark, d, "*.parquet").select("name", "size")


@query("select event_id, user_id, event_type from events")
def S18_incremental(spark, d):
    """All files of a name that have arrived, through the streaming source, into a table of their own."""
    base = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    schema = load(spark, d, "events").schema
    q = ingest.new_rows(spark, d, schema, f"{base}/state", f"{base}/table", "events*.parquet")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/table").select("event_id", "user_id", "event_type")


@query("select id, stream_id, cast(sum(case when g is null or g > 300 then 1 else 0 end) over (partition by stream_id order by id) as bigint) as session from (select id, stream_id, id - lag(id) over (partition by stream_id order by id) as g from packet)", "packet")
def T8_stateful_sessions(spark, d):
    """Sessions by packet count, the stream read by the streaming source and kept as state."""
    base = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    rows = spark.readStream.schema(load(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    out = stream_flows.sessions(rows.select(F.col("user_id").alias("stream"), F.col("event_id").alias("id")), 300)
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/table").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/table").select("id", F.col("stream").alias("stream_id"), "session")


@query("select event_type, count(*) as n from events group by 1")
def K5_periodic_export(spark, d):
    """Each batch that brought rows is exported; the exports together hold every row."""
    base = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    rows = spark.readStream.schema(load(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    ingest.periodic_export(rows, lambda b, n: b.write.mode("overwrite").parquet(f"{base}/table/batch={n}"), f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select 167772160 + c_custkey as start_ip, cast(c_nationkey + 1 as bigint) as numhosts, upper(c_mktsegment) as country, 'allocated' as status from customer")
def S19_registry_records(spark, d):
    ip = net.long_to_ip(F.lit(167772160) + F.col("c_custkey"))
    c = load(spark, d, "customer")
    return reference.registry_records(c.select(F.concat_ws("|", F.lit("ripe"), F.lower("c_mktsegment"), F.lit("ipv4"), ip, (F.col("c_nationkey") + 1).cast("string"), F.lit("20010101"), F.lit("ALLOCATED PA")).alias("value")))


@query("select distinct p_name as word, 'English' as class, 'word' as word_type from part where length(p_name) >= 3")
def S19_word_list(spark, d):
    return reference.word_list(load(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("value")))


@query("select upper(md5(p_name)) as md5, p_name as filename, p_size as productcode from part")
def S19_known_digests(spark, d):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lines = load(spark, d, "part").select(F.concat_ws(",", quoted(F.lit("00")), quoted(F.md5("p_name")), quoted(F.lit("0")), quoted("p_name"), F.lit("1"), F.col("p_size").cast("string"), quoted(F.lit("WIN")), quoted(F.lit(""))).alias("value"))
    return reference.known_digests(lines).select(F.hex("md5").alias("md5"), "filename", "productcode")


# ---- flows ----------------------------------------------------------------------------------------------------------


@query("select user_id as stream, cast(count(*) as bigint) as segments from events group by 1")
def T6_lifecycle(spark, d):
    """Reported segments per stream: each is data, a retransmission or empty."""
    events = flows.reassembled(joins._segments(spark, d)).select("stream", F.explode("events").alias("e"))
    kept = events.filter(F.col("e").rlike(":(data|retran|misc)$"))
    return kept.groupBy("stream").agg(F.count(F.lit(1)).alias("segments"))


@query()
def T4_padded(spark, d):
    return flows.reassembled(joins._segments(spark, d)).select("stream", "session", F.octet_length("content").alias("bytes"))


@query("select distinct stream, session from (select user_id as stream, sum(case when g is null or g > 2000 then 1 else 0 end) over (partition by user_id order by event_id)::bigint as session from (select *, event_id - lag(event_id) over (partition by user_id order by event_id) as g from events))")
def T10_destroyed(spark, d):
    """Every session of every stream ends with its destruction, whatever gaps were left."""
    rows = flows.reassembled(joins._segments(spark, d))
    return rows.filter(F.element_at("events", -1).endswith(":destroy")).select("stream", "session")


# ---- remaining canned queries ---------------------------------------------------------------------------------------


@query(SQL["A7_timeline"])
def Q14_file_timeline(spark, d):
    return QUERIES["A7_timeline"](spark, d)


@query(SQL["A6_bandwidth"])
def Q16_bandwidth(spark, d):
    return QUERIES["A6_bandwidth"](spark, d)


@query("select name as \"Name\", total as \"Rows\" from (select 'events' as name, count(*) as total from events union all select 'packet', count(*) from events)")
def Q15_log_tables(spark, d):
    return analytics.signature({"events": load(spark, d, "events"), "packet": relation(spark, d, "packet")}).select(F.col("tbl").alias("Name"), F.col("rows").alias("Rows"))


@query("select distinct concat('n', cast(n_nationkey as string)) as name, concat('r', cast(n_regionkey as string)) as next from nation where n_name like '%1%'")
def Q19_knowledge_search(spark, d):
    places = load(spark, d, "nation").selectExpr("concat('n', cast(n_nationkey as string)) as name", "concat('r', cast(n_regionkey as string)) as pname", "n_name")
    return lookup.graph_step(places, places.filter(F.col("n_name").contains("1")))


@query("select cast(id as bigint) as id, name from (select distinct t.id, t.name, t.parent from tree t) where id is not null and (parent is null or parent = 0 or parent not in (select id from tree where id is not null))")
def Q20_tree_roots(spark, d):
    return hierarchy.links(load(spark, d, "tree")).filter("parent is null").select("id", "name")


@query("select min(event_id) as lowest, max(event_id) as highest, count(*) as n from events")
def Q21_statistics(spark, d):
    return load(spark, d, "events").agg(F.min("event_id").alias("lowest"), F.max("event_id").alias("highest"), F.count(F.lit(1)).alias("n"))


# Names of canned queries by subject, as a tree to choose from.
CATALOGUE = {"files": ["Q1_large_by_magic", "Q2_by_magic", "Q14_file_timeline"], "web": ["Q3_html_urls", "Q4_media_urls", "Q5_searches", "Q6_requests_by_domain", "Q11_browse_http", "Q22_parameters_of_one"],
             "network": ["Q7_connections", "Q8_messages", "Q9_sessions_with_endpoints", "Q16_bandwidth"], "case": ["Q10_browse_simple", "Q12_composed_table", "Q18_case_notes", "Q19_knowledge_search", "Q20_tree_roots", "Q21_statistics"]}


@query()
def Q13_catalogue(spark, d):
    return spark.createDataFrame([(s, n) for s, names in CATALOGUE.items() for n in names], "subject string, name string")


@query("select user_id, event_id from events where value > 300 and user_id < 100")
def K9_filtered_export(spark, d):
    """What the command line's export writes, read again."""
    from caseframe import cli

    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}.csv"
    cli.export(load(spark, d, "events"), ["user_id", "event_id"], "value > 300 and user_id < 100", folder)
    return spark.read.option("header", "true").csv(folder).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"))
