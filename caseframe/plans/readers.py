"""Sources and sinks (S, K): lines written from events and read back, listings, presets, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe.functions import net
from caseframe.operators import analytics, lookup
from caseframe.plans.joins import geo
from caseframe.plans.registry import query, relation
from caseframe.session import load
from caseframe.sources import exports, listing, logs

def _lines(spark, d, *parts) -> DataFrame:
    """Log lines of the events: texts and columns one after the other."""
    return load(spark, d, "events").select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))


def _s(name: str):
    return F.col(name).cast("string")


def _time(form: str):
    return F.date_format("ts", form)


def _cents():
    return F.floor(F.col("value") * 100).cast("long")


def _address():
    return net.long_to_ip(F.lit(167772160) + F.col("user_id"))


@query("select count(*) as n from events where event_type not in ('error', 'signup')")
def S1_lines(spark, d):
    mark = F.when(F.col("event_type") == "error", "# ").when(F.col("event_type") == "signup", "   ").otherwise("")
    body = F.when(F.col("event_type") == "signup", "").otherwise(_s("event_id"))
    return logs.keep_records(_lines(spark, d, mark, body)).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, user_id, event_type from events where user_id < 50 and event_type = 'view'")
def S2_filtered_load(spark, d):
    types = [C.BigIntegerType("event_id"), C.BigIntegerType("user_id"), C.StringType("event_type")]
    rows = logs.simple(_lines(spark, d, _s("event_id"), " ", _s("user_id"), "  ", F.col("event_type")), types)
    return logs.load(rows, {t.name: t for t in types}, "user_id < 50 and event_type = view")


@query("select event_id, date_trunc('second', ts) as at, 167772160 + user_id as ip, event_type from events")
def S3_simple(spark, d):
    lines = _lines(spark, d, _s("event_id"), "|", F.unix_timestamp("ts").cast("string"), "|skipped|", _address(), "|  ", F.col("event_type"), " ")
    rows = logs.simple(lines, [C.BigIntegerType("event_id"), C.EpochTimestampType("at"), None, C.IPType("ip"), C.StringType("event_type")], "[|]")
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select event_id, date_trunc('second', ts) as at, cast(date_trunc('day', ts) as timestamp) as day, event_type from events")
def S4_prefilters(spark, d):
    lines = _lines(spark, d, _s("event_id"), ";[", _time("d/MMM/yyyy:HH:mm:ss"), "];'", _time("dd/MM/yyyy"), "';\"", F.col("event_type"), '"')
    fixed = logs.prefilter(lines, ["strip_brackets", "strip_quotes", "day_monthname_year", "day_month_year"])
    rows = logs.simple(fixed, [C.BigIntegerType("event_id"), C.TimestampType("at", form="yyyy-MM-d HH:mm:ss"), C.TimestampType("day", form="yyyy-MM-dd"), C.StringType("event_type")], ";")
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("select event_id, concat(event_type, ', with comma') as label, value from events")
def S5_csv(spark, d):
    return logs.csv(_lines(spark, d, _s("event_id"), ',"', F.col("event_type"), ', with comma",', _s("value")), [C.BigIntegerType("event_id"), C.StringType("label"), C.FloatType("value")])


@query("select 167772160 + user_id as rhost, date_trunc('second', ts) as time, case event_type when 'error' then 404 else 200 end as status, cast(floor(value * 100) as bigint) as size, 'GET' as method, concat('/', event_type, '?id=', cast(event_id as string)) as request, 'HTTP/1.0' as protocol, cast(null as string) as ruser, 'agent \"x\"' as user_agent from events")
def S6_apache(spark, d):
    status = F.when(F.col("event_type") == "error", "404").otherwise("200")
    lines = _lines(spark, d, _address(), " - - [", _time("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', F.col("event_type"), "?id=", _s("event_id"), ' HTTP/1.0" ', status, " ", _cents().cast("string"), ' "-" "agent \\"x\\""')
    rows = logs.apache(lines, "combined")
    return rows.select("rhost", F.col("time").cast("timestamp_ntz").alias("time"), "status", "size", "method", "request", "protocol", "ruser", F.replace("user_agent", F.lit("\\"), F.lit("")).alias("user_agent"))


@query("select date_trunc('second', ts) as timestamp, 167772160 + user_id as c_ip, 'GET' as cs_method, case event_type when 'error' then 404 else 200 end as sc_status, cast(floor(value * 100) as bigint) as sc_bytes, cast(null as string) as cs_username from events")
def S7_iis(spark, d):
    status = F.when(F.col("event_type") == "error", "404").otherwise("200")
    rows = _lines(spark, d, _time("yyyy-MM-dd HH:mm:ss"), " ", _address(), " GET ", status, " ", _cents().cast("string"), " -")
    head = spark.createDataFrame([("#Fields: date time c-ip cs-method sc-status sc-bytes cs-username",)], "value string")
    got = logs.iis(head.unionByName(rows))
    return got.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("select date_trunc('second', ts) as timestamp, concat('host', cast(user_id as string)) as hostname, event_type as service, concat('message ', cast(event_id as string)) as message from events")
def S8_syslog(spark, d):
    lines = _lines(spark, d, _time("MMM d HH:mm:ss"), " host", _s("user_id"), " ", F.col("event_type"), "[77]: message ", _s("event_id"))
    return logs.syslog(lines, 2024).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("select date_trunc('second', ts) as time, upper(event_type) as action, 167772160 + user_id as src, cast(floor(value) as bigint) as len, 'TCP' as proto, 16 as tos from events where event_type <> 'view'")
def S9_iptables(spark, d):
    body = F.when(F.col("event_type") == "view", "nothing to see").otherwise(F.concat(F.lit("IN=eth0 OUT= SRC="), _address(), F.lit(" DST=192.168.0.1 LEN="), F.floor("value").cast("string"), F.lit(" TOS=0x10 PROTO=TCP SPT=1 DPT=80")))
    lines = _lines(spark, d, _time("MMM d HH:mm:ss"), " gw kernel: ", F.upper("event_type"), " ", body)
    rows = logs.iptables(lines, 2024)
    return rows.select(F.col("time").cast("timestamp_ntz").alias("time"), "action", F.col("SRC").alias("src"), F.col("LEN").alias("len"), F.col("PROTO").alias("proto"), F.col("TOS").cast("int").alias("tos"))


@query("""select date_trunc('second', ts) as timestamp, case event_type when 'click' then 'Built' when 'view' then 'Teardown' else 'Deny' end as action, case event_type when 'click' then 'outbound' end as direction,
case when event_type in ('click', 'view') then event_id end as conn_number, 167772160 + user_id as src_host, 80 as dst_port, case event_type when 'view' then cast(floor(value) as bigint) end as bytes from events where event_type in ('click', 'view', 'error')""")
def S10_firewall(spark, d):
    a = _address()
    kind = F.col("event_type")
    built = F.concat(F.lit("Built outbound TCP connection "), _s("event_id"), F.lit(" for in:"), a, F.lit("/1025 (x) to out:1.2.3.4/80 (y)"))
    gone = F.concat(F.lit("Teardown TCP connection "), _s("event_id"), F.lit(" for in:"), a, F.lit("/1025 to out:1.2.3.4/80 duration 0:00:01 bytes "), F.floor("value").cast("string"))
    deny = F.concat(F.lit("Deny tcp src in:"), a, F.lit("/1025 dst out:1.2.3.4/80 by rule"))
    lines = _lines(spark, d, _time("MMM d HH:mm:ss"), " fw ", "%PIX-6-302013: ", F.when(kind == "click", built).when(kind == "view", gone).when(kind == "error", deny).otherwise("other"))
    rows = logs.pix_connections(logs.pix_messages(lines, 2024))
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "action", "direction", "conn_number", "src_host", "dst_port", "bytes")


@query("select date_trunc('second', ts) as at, concat('host', cast(user_id as string)) as host, event_id as number from events")
def S12_advanced(spark, d):
    lines = _lines(spark, d, _time("yyyy-MM-dd HH:mm:ss"), " <host", _s("user_id"), "> noise; n=", _s("event_id"), " rest")
    rows = logs.advanced(lines, [logs.Consumed(C.TimestampType("at")), logs.Consumed(C.StringType("host"), " <", "[^>]+"), logs.Consumed(C.PadType("pad"), "> ", "[a-z]+"), logs.Consumed(C.BigIntegerType("number"), "; n=")])
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select event_id, event_type from events")
def S13_preset(spark, d):
    presets = logs.Presets()
    presets.save(logs.Preset("events", "simple", [("BigIntegerType", "event_id"), ("StringType", "event_type")], {"delimiter": ","}))
    return presets.restore("events").read(_lines(spark, d, _s("event_id"), ",", F.col("event_type")))


@query("select name, size from (select f.name, i.size, f.path from file f join inode i using (inode_id)) where path = '/mail/de/'", "file", "inode")
def S20_listing(spark, d):
    return listing.ls(relation(spark, d, "file"), relation(spark, d, "inode"), "/mail/de").select("name", "size")


@query("select distinct case when path like '/mail/%' then split_part(path, '/', 3) end as name from file where path like '/mail/%' and path <> '/mail/'", "file")
def S20_directories(spark, d):
    return listing.directories(relation(spark, d, "file"), "/mail")


@query("select inode_id, concat(path, name) as full_name, status, size from (select f.*, i.size from file f join inode i using (inode_id)) where name like 'doc11.%'", "file", "inode")
def S20_stat(spark, d):
    files, inodes = relation(spark, d, "file"), relation(spark, d, "inode")
    found = files.filter(F.col("name").like("doc11.%")).select(F.concat("path", "name").alias("full_name"))
    return listing.stat(files, inodes, found)


@query("select cast(event_id as string) as event_id, event_type, props from events")
def K1_csv_export(spark, d):
    """Every row as it is read again from the export."""
    return exports.csv_round_trip(load(spark, d, "events").select("event_id", "event_type", "props"))


@query("""with cache as (select 167772160 + c_custkey as ip, c_nationkey as country, length(c_mktsegment) % 5 as city, c_custkey % 100 as isp, c_custkey as org from customer where c_custkey > 30)
select inode_id, concat('10.0.', cast((e.src_ip >> 8) & 255 as string), '.', cast(e.src_ip & 255 as string)) as src_ip, coalesce(n_name, 'Unknown') as src_ip_country, coalesce(r_name, 'Unknown') as src_ip_city, coalesce(s_name, 'Unknown') as src_ip_isp, coalesce(p_name, 'Unknown') as src_ip_org
from (select event_id as inode_id, 167772160 + user_id as src_ip from events) e left join cache on ip = e.src_ip left join nation on n_nationkey = country left join region on r_regionkey = city left join supplier on s_suppkey = isp left join part on p_partkey = org""")
def K2_enriched_export(spark, d):
    cache, dims = geo(spark, d)
    rows = lookup.enriched(relation(spark, d, "connection_details").select("inode_id", "src_ip"), "src_ip", cache.filter("ip > 167772190"), dims)
    return rows.select("inode_id", net.long_to_ip(F.col("src_ip")).alias("src_ip"), *[f"src_ip_{n}" for n in dims])


@query("select cast(ceil(row_number() over (order by event_id) / 50.0) as bigint) as page, event_id from events")
def K3_paged_export(spark, d):
    return analytics.paged(load(spark, d, "events").select("event_id"), "event_id", 50).select("page", "event_id")


@query("select id, min(network) as network from (select whois_id as id, network from whois_routes) group by 1")
def K7_insert_ignore(spark, d):
    return exports.without_duplicates(load(spark, d, "whois_routes").select(F.col("whois_id").alias("id"), "network"), ["id"], "network")


@query("select n_nationkey, case when n_regionkey = 1 then 'changed' else n_name end as n_name, n_regionkey from nation where n_regionkey <> 2 union all select 99, 'new', 0")
def K8_changes(spark, d):
    t = exports.deleted(load(spark, d, "nation"), F.col("n_regionkey") == 2)
    t = exports.updated(t, F.col("n_regionkey") == 1, n_name=F.lit("changed"))
    return exports.inserted(t, n_nationkey=99, n_name="new", n_regionkey=0)
