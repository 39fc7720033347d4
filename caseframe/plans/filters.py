"""Projection, filter language, order and page (F, O) and the canned table queries built of them (Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe import query as Q
from caseframe.functions import net, text
from caseframe.plans.registry import query, relation
from caseframe.session import load


def events_columns() -> list[C.ColumnType]:
    return [C.BigIntegerType("event_id"), C.TimestampType("ts"), C.BigIntegerType("user_id"), C.StateType("event_type", states={n.title(): n for n in ("click", "error", "purchase", "signup", "view")}), C.FloatType("value"), C.StringType("props")]


def _events(spark: SparkSession, d: str, filter_text: str, **kw) -> DataFrame:
    cols = events_columns()
    kw.setdefault("order", None)
    return Q.run(Q.QuerySpec(cols, filter_text, **kw), {"events": load(spark, d, "events")})


def _ips(spark: SparkSession, d: str, filter_text: str) -> DataFrame:
    cols = [C.BigIntegerType("inode_id"), C.IPType("src_ip"), C.IPType("dest_ip"), C.ShortIntegerType("dest_port")]
    return Q.run(Q.QuerySpec(cols, filter_text, order=None), {"c": relation(spark, d, "connection_details")})


_E = "select event_id, ts, user_id, event_type, value, props from events where "
_DOT = "concat(cast({0} >> 24 as string), '.', cast(({0} >> 16) & 255 as string), '.', cast(({0} >> 8) & 255 as string), '.', cast({0} & 255 as string))"
_IP = "select inode_id, " + _DOT.format("src_ip") + " as src_ip, " + _DOT.format("dest_ip") + " as dest_ip, dest_port from connection_details where "


@query("select event_id as \"Event\", value as \"Amount\" from events")
def F1_select_alias(spark, d):
    return Q.run(Q.QuerySpec([C.BigIntegerType("Event", "event_id"), C.FloatType("Amount", "value")], order=None), {"events": load(spark, d, "events")})


@query("select event_id, user_id, event_type from events")
def F2_hide_columns(spark, d):
    return _events(spark, d, "", hidden=(1, 4, 5))


@query(_E + "event_type = 'error'")
def F3_equal(spark, d):
    return _events(spark, d, "event_type = error")


@query(_E + "user_id <> 7 and value >= 50 and value < 90 and event_id <= 9000 and user_id > 3")
def F4_comparisons(spark, d):
    return _events(spark, d, "user_id != 7 and value >= 50 and value < 90 and event_id <= 9000 and user_id > 3")


@query(_E + "user_id = 16")
def F5_int_coercion(spark, d):
    return _events(spark, d, "user_id = 0x10")


@query("select c_custkey, c_name from customer where lower(c_name) like '%r#00000001%'")
def F6_contains(spark, d):
    return Q.run(Q.QuerySpec([C.BigIntegerType("c_custkey"), C.StringType("c_name")], 'c_name contains "R#00000001"', order=None), {"t": load(spark, d, "customer")})


@query("select p_partkey, p_name from part where p_name ilike 'red%t'")
def F7_matches(spark, d):
    return Q.run(Q.QuerySpec([C.BigIntegerType("p_partkey"), C.StringType("p_name")], 'p_name matches "RED%t"', order=None), {"t": load(spark, d, "part")})


@query("select p_partkey, p_name from part where regexp_matches(p_name, '(?i)^(red|blue) b')")
def F8_regex(spark, d):
    return Q.run(Q.QuerySpec([C.BigIntegerType("p_partkey"), C.StringType("p_name")], "p_name regex '^(RED|blue) b'", order=None), {"t": load(spark, d, "part")})


@query(_E + "event_type = 'signup'")
def F9_is_state(spark, d):
    return _events(spark, d, "event_type is SIGNUP")


@query(_E + "ts > timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 12:00:00'")
def F10_after_before(spark, d):
    return _events(spark, d, "ts after 2024-01-10 and ts before '20 Jan 2024 12:00:00'")


@query(_IP + "src_ip = 167772170", "connection_details")
def F11_ip_equal(spark, d):
    return _ips(spark, d, "src_ip = 10.0.0.10")


@query(_IP + "src_ip >= 167772260 and dest_ip <> 3232235781", "connection_details")
def F12_ip_compare(spark, d):
    return _ips(spark, d, "src_ip >= 10.0.0.100 and dest_ip != 192.168.1.5")


@query(_IP + "src_ip between 167772169 and 167772415 or dest_ip between 3232235780 and 3232235783", "connection_details")
def F13_netmask(spark, d):
    return _ips(spark, d, "src_ip netmask 10.0.0.9/24 or dest_ip matches 192.168.1.4/30")


@query("select id, stream_id, length from packet where id >= (select min(id) from packet where ts > timestamp '2024-01-05 00:00:00') and id <= (select max(id) from packet where ts < timestamp '2024-01-09 00:00:00')", "packet")
def F14_packet_time(spark, d):
    packets = relation(spark, d, "packet")
    cols = [C.PacketType("id"), C.BigIntegerType("stream_id"), C.BigIntegerType("length")]
    spec = Q.QuerySpec(cols, "when after 2024-01-05 and when before 2024-01-09", [C.PCAPTimeType("when", "id", packets=packets)], order=None)
    return Q.run(spec, {"p": packets})


def _inodes(spark: SparkSession, d: str) -> C.InodeIDType:
    return C.InodeIDType("inode_id", table="file", inodes=relation(spark, d, "inode"), annotations=relation(spark, d, "annotate"), types=relation(spark, d, "type"))


def _files(spark: SparkSession, d: str, filter_text: str, more: tuple = ()) -> DataFrame:
    files = relation(spark, d, "file")
    cols = [_inodes(spark, d), C.StringType("path", table="file"), C.StringType("name", table="file")]
    return Q.run(Q.QuerySpec(cols, filter_text, [C.FilenameType("filename", files=files), C.InodeInfoType("inode", inodes=relation(spark, d, "inode")), *more], order=None), {"file": files})


@query("select inode_id, path, name from file where inode_id in (select inode_id from inode where lower(inode) like '%iusb%')", "file", "inode")
def F15_inode_contains(spark, d):
    return _files(spark, d, "inode_id contains Iusb")


@query("select inode_id, path, name from file where lower(concat(path, name)) like '%/mail/en/doc1%'", "file")
def F16_filename_semijoin(spark, d):
    return _files(spark, d, "filename contains /mail/en/doc1")


@query("select inode_id, path, name from file where inode_id in (select inode_id from inode where regexp_matches(inode, '(?i)d[0-9]*7$'))", "file", "inode")
def F18_inodeinfo_semijoin(spark, d):
    return _files(spark, d, "inode regex 'd[0-9]*7$'")


@query("select inode_id, path, name from file where inode_id in (select inode_id from annotate where lower(note) like '%law%')", "file", "annotate")
def F19_annotated(spark, d):
    return _files(spark, d, "inode_id annotated law")


@query("select inode_id, path, name from file where inode_id in (select inode_id from type where lower(type) like '%html%') or path = '/mail/de/'", "file", "type")
def F20_has_magic(spark, d):
    return _files(spark, d, "inode_id has_magic HTML or path = /mail/de/")


@query("select h.inode_id, h.word_id, h.pos, w.class, w.word_type from hit h join word w on w.word_id = h.word_id where w.word_type = 'regex'", "hit", "word")
def F22_word_hit(spark, d):
    tables = {"hit": relation(spark, d, "hit"), "word": relation(spark, d, "word")}
    cols = [C.BigIntegerType("inode_id", table="hit"), C.BigIntegerType("word_id", table="hit"), C.BigIntegerType("pos", table="hit"), C.StringType("class", table="word"), C.WordType("word_type", table="word")]
    return Q.run(Q.QuerySpec(cols, "word_type = REGEX", order=None, key="word_id"), tables)


@query("select word_id, class from word where substr(class, 1, 1) <> '_'", "word")
def F23_private_classes(spark, d):
    return Q.run(Q.QuerySpec([C.BigIntegerType("word_id"), C.ClassType("class")], order=None), {"word": relation(spark, d, "word")})


@query("select distinct concat(path, name) as full_name from file where regexp_matches(concat(path, name), '^/ma[^/]*/[a-f][^/]/doc[^/]*5[.]eml$')", "file")
def F24_glob(spark, d):
    return glob(relation(spark, d, "file"), "/ma*/[a-f]?/doc*5.eml")


def glob(files: DataFrame, pattern: str) -> DataFrame:
    """Distinct full names of files that a glob names."""
    full = F.concat("path", "name")
    fixed = not any(ch in pattern for ch in "*?[")
    return files.filter(full == pattern if fixed else full.rlike(text.glob_regex(pattern))).select(full.alias("full_name")).distinct()


@query(_E + "(event_type = 'error' or event_type = 'click' and value > 80) and (user_id < 20 or user_id > 130)")
def F25_precedence(spark, d):
    return _events(spark, d, "(event_type is error or event_type is click AND value > 80) and (user_id < 20 Or user_id > 130)")


@query(_E + "value > 200")
def F26_unknown_column(spark, d):
    return _events(spark, d, "nothing = 1 and value > 200", unknown="true")


@query()
def F27_operators(spark, d):
    return spark.createDataFrame([(k, n) for k, v in C.registry().items() for n in v], "column_type string, operator string")


@query(_E + "props is not null and value > 100 and event_type = 'view'")
def F28_where_and_filter(spark, d):
    return _events(spark, d, "value > 100", where=F.col("props").isNotNull() & (F.col("event_type") == "view"))


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
def F29_select_equal(spark, d):
    return select_equal(load(spark, d, "orders"), o_orderstatus="F", o_orderpriority="5-LOW").select("o_orderkey", "o_custkey")


def select_equal(table: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values."""
    for k, v in values.items():
        table = table.filter(F.col(k).isNull() if v is None else F.col(k) == v)
    return table


def violations(table: DataFrame, key: str, unique: bool = False, refers: tuple[DataFrame, str] | None = None, filled: bool = False) -> DataFrame:
    """(key, problem) of the values of a column that break a constraint."""
    value = F.col(key).cast("string").alias("key")
    out = []
    if unique:
        out.append(table.filter(F.col(key).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit("not unique").alias("problem")))
    if refers:
        other, column = refers
        known = other.select(F.col(column).alias("_k")).distinct()
        keys = table.filter(F.col(key).isNotNull()).select(F.col(key).alias("_v")).distinct()
        out.append(keys.join(known, F.col("_v") == F.col("_k"), "left_anti").select(F.col("_v").cast("string").alias("key"), F.lit("refers to nothing").alias("problem")))
    if filled:
        out.append(table.filter(F.col(key).isNull() | (value == "")).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("key"), F.lit("empty").alias("problem")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


@query("""select cast(src_id as string) as key, 'not unique' as problem from whois where src_id is not null group by 1 having count(*) > 1
union all select distinct cast(src_id as string), 'refers to nothing' from whois where src_id is not null and src_id not in (select id from whois_sources)
union all select null, 'empty' from (select count(*) as n from whois where src_id is null) where n > 0""")
def F30_constraints(spark, d):
    return violations(load(spark, d, "whois"), "src_id", unique=True, refers=(load(spark, d, "whois_sources"), "id"), filled=True)


# ---- order and page -------------------------------------------------------------------------------------------------


@query("select event_id, ts, user_id, event_type, value, props from events where event_type = 'error' and value > 10 order by value desc, event_id limit 50")
def O1_order_descending(spark, d):
    return _events(spark, d, '"event_type" = error and "value" > 10', order=4, ties=("event_id",), limit=Q.PAGE)


@query("select event_id, ts, user_id, event_type, value, props from events order by value, event_id limit 50 offset 100")
def O2_page(spark, d):
    return _events(spark, d, "", order=4, ascending=True, ties=("event_id",), offset=100, limit=Q.PAGE)


@query("select event_id, user_id from events order by event_id desc limit 10")
def O3_recent(spark, d):
    return Q.recent(load(spark, d, "events").select("event_id", "user_id"), "event_id")


@query("select path, min(inode_id) as inode_id, arg_min(name, inode_id) as name from file group by path", "file")
def O4_first_match(spark, d):
    return relation(spark, d, "file").groupBy("path").agg(F.min("inode_id").alias("inode_id"), F.min_by("name", "inode_id").alias("name"))


@query("select least(count(*), 3) as n from events")
def O5_trial_load(spark, d):
    from caseframe.sources import logs

    return logs.load(load(spark, d, "events"), {}, limit=3).agg(F.count(F.lit(1)).alias("n"))


# ---- canned queries -------------------------------------------------------------------------------------------------


def _canned(spark: SparkSession, d: str, filter_text: str, cols: list[C.ColumnType], names: list[str], filters: list | None = None, **kw) -> DataFrame:
    tables = {n: relation(spark, d, n) for n in names}
    kw.setdefault("order", None)
    return Q.run(Q.QuerySpec(cols, filter_text, filters or [], **kw), tables)


@query("select i.inode_id, concat(f.path, f.name) as \"Filename\", i.size as \"Size\" from file f join inode i using (inode_id) join type t using (inode_id) where lower(t.type) like '%mail%' and i.size > 900", "inode", "file", "type")
def Q1_large_by_magic(spark, d):
    key = C.InodeIDType("inode_id", table="file", types=relation(spark, d, "type"))
    return _canned(spark, d, "inode_id has_magic mail and Size > 900", [key, C.FilenameType("Filename", table="file"), C.BigIntegerType("Size", "size", "inode")], ["file", "inode"])


@query("select inode_id, mime, type from type where lower(type) like '%html%' or lower(type) like '%chat%'", "type")
def Q2_by_magic(spark, d):
    key = C.InodeIDType("inode_id", table="type", types=relation(spark, d, "type"))
    return _canned(spark, d, "inode_id has_magic html or inode_id has_magic chat", [key, C.StringType("mime", table="type"), C.StringType("type", table="type")], ["type"])


@query("select inode_id, url from http where lower(content_type) like '%html%' and status = 200", "http")
def Q3_html_urls(spark, d):
    return _canned(spark, d, "content_type contains html and status = 200", [C.BigIntegerType("inode_id", table="http"), C.StringType("url", table="http"), C.StringType("content_type", table="http"), C.IntegerType("status", table="http")], ["http"], hidden=(2, 3))


@query("select h.inode_id, h.url, t.type from http h join type t using (inode_id) join inode i using (inode_id) where (lower(h.content_type) like '%image%' or lower(h.content_type) like '%video%') and i.size > 100", "http", "type", "inode")
def Q4_media_urls(spark, d):
    cols = [C.BigIntegerType("inode_id", table="http"), C.StringType("url", table="http"), C.StringType("type", table="type")]
    return _canned(spark, d, "(content_type contains image or content_type contains video) and size > 100", cols, ["http", "type", "inode"], [C.StringType("content_type", table="http"), C.BigIntegerType("size", table="inode")])


@query("""select inode_id, host, replace(regexp_extract(url, '[?&]q=([^&]*)', 1), '+', ' ') as value from http where lower(host) like '%site1%'""", "http")
def Q5_searches(spark, d):
    params = relation(spark, d, "http").select("inode_id", F.explode(net.query_parameters(F.col("url"))).alias("p")).select("inode_id", "p.key", "p.value")
    tables = {"http": relation(spark, d, "http"), "parameters": params}
    cols = [C.BigIntegerType("inode_id", table="http"), C.StringType("host", table="http"), C.StringType("value", table="parameters")]
    return Q.run(Q.QuerySpec(cols, "key = q and host contains site1", [C.StringType("key", table="parameters")], order=None), tables)


@query("select concat('site', cast(user_id as string), case when user_id < 50 then '.com.au' when user_id < 100 then '.example.org' else '.co.uk' end) as tld, count(*) as \"Count\" from events group by 1")
def Q6_requests_by_domain(spark, d):
    http = relation(spark, d, "http").withColumn("tld", net.registrable_domain(F.col("host")))
    http = http.withColumn("tld", F.when(F.col("tld").startswith("example."), F.concat(F.regexp_extract("host", "(site[0-9]+)", 1), F.lit("."), F.col("tld"))).otherwise(F.col("tld")))
    return Q.run(Q.QuerySpec([C.StringType("tld")], group=0), {"http": http})


@query("select inode_id, " + _DOT.format("src_ip") + " as src_ip, src_port, " + _DOT.format("dest_ip") + " as dest_ip, dest_port, ts_sec from connection_details", "connection_details")
def Q7_connections(spark, d):
    cols = [C.BigIntegerType("inode_id"), C.IPType("src_ip"), C.ShortIntegerType("src_port"), C.IPType("dest_ip"), C.ShortIntegerType("dest_port"), C.TimestampType("ts_sec")]
    return Q.run(Q.QuerySpec(cols, order=None), {"c": relation(spark, d, "connection_details")})


@query("select c.inode_id, c.command, c.data from command c where lower(c.command) = 'retr'", "command")
def Q8_messages(spark, d):
    cols = [C.BigIntegerType("inode_id"), C.StringType("command"), C.StringType("data")]
    return Q.run(Q.QuerySpec(cols, "command = RETR", order=None), {"command": relation(spark, d, "command")})


@query("select c.ftp_session_id, c.command, s.username, " + _DOT.format("s.server_ip") + " as server_ip from (select inode_id, ftp_session_id, command from command) c join (select distinct inode_id, username, server_ip from session) s on s.inode_id = c.ftp_session_id", "command", "session")
def Q9_sessions_with_endpoints(spark, d):
    sessions = relation(spark, d, "session").select(F.col("inode_id").alias("ftp_session_id"), "username", "server_ip").distinct()
    cols = [C.BigIntegerType("ftp_session_id", table="command"), C.StringType("command", table="command"), C.StringType("username", table="session"), C.IPType("server_ip", table="session")]
    return Q.run(Q.QuerySpec(cols, order=None, key="ftp_session_id"), {"command": relation(spark, d, "command").select("ftp_session_id", "command"), "session": sessions})


@query("select id, netname, numhosts, country from whois")
def Q10_browse_simple(spark, d):
    return Q.run(Q.QuerySpec([C.IntegerType("id"), C.StringType("netname"), C.BigIntegerType("numhosts"), C.StringType("country")], order=None), {"whois": load(spark, d, "whois")})


@query("select inode_id, method, url, status from http where url ilike '%/view?%'", "http")
def Q11_browse_http(spark, d):
    cols = [C.BigIntegerType("inode_id"), C.StringType("method"), C.StringType("url"), C.IntegerType("status")]
    return Q.run(Q.QuerySpec(cols, 'url matches "%/view?%"', order=None), {"http": relation(spark, d, "http")})


@query("select i.inode_id, f.name, t.mime, i.status, i.mtime from inode i join file f using (inode_id) join type t using (inode_id)", "inode", "file", "type")
def Q12_composed_table(spark, d):
    cols = [C.BigIntegerType("inode_id", table="inode"), C.StringType("name", table="file"), C.StringType("mime", table="type"), C.DeletedType("status", table="inode"), C.TimestampType("mtime", table="inode")]
    tables = {"inode": relation(spark, d, "inode"), "file": relation(spark, d, "file").drop("status", "inode"), "type": relation(spark, d, "type")}
    return Q.run(Q.QuerySpec(cols, order=None), tables)


@query("select inode_id, note, category from annotate where note in ('law', 'finance')", "annotate")
def Q18_case_notes(spark, d):
    cols = [C.BigIntegerType("inode_id"), C.StringType("note"), C.StringType("category")]
    return Q.run(Q.QuerySpec(cols, "note = law or note = finance", order=None), {"annotate": relation(spark, d, "annotate")})


@query("select 5 as inode_id, 'q' as key, concat(event_type, ' ', cast(user_id as string)) as value from events where event_id = 5 union all select 5, 'page', '5' from events where event_id = 5")
def Q22_parameters_of_one(spark, d):
    rows = relation(spark, d, "http").filter(F.col("inode_id") == 5)
    return rows.select(F.col("inode_id").cast("int").alias("inode_id"), F.explode(net.query_parameters(F.col("url"))).alias("p")).select("inode_id", "p.key", "p.value")
