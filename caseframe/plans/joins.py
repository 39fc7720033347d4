"""Joins (J), aggregates (A), windows (W), sets (U), streams in batch (T) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe import query as Q
from caseframe.operators import analytics, flows, lookup, running
from caseframe.plans.registry import query, relation
from caseframe.session import load
from caseframe.sources import logs

# ---- joins ----------------------------------------------------------------------------------------------------------


@query("select f.inode_id, f.name, t.type, i.size from file f join type t using (inode_id) join inode i using (inode_id) where i.size > 500 and lower(t.type) like '%text%'", "file", "type", "inode")
def J1_star(spark, d):
    cols = [C.BigIntegerType("inode_id", table="file"), C.StringType("name", table="file"), C.StringType("type", table="type"), C.BigIntegerType("size", table="inode")]
    return Q.run(Q.QuerySpec(cols, "size > 500 and type contains text", order=None), {n: relation(spark, d, n) for n in ("file", "type", "inode")})


@query("select i.inode_id, i.size, f.name from inode i left join (select inode_id, name from file where status = 'deleted') f on f.inode_id = i.inode_id", "inode", "file")
def J2_inode_left_file(spark, d):
    deleted = relation(spark, d, "file").filter("status = 'deleted'").select("inode_id", "name")
    return relation(spark, d, "inode").select("inode_id", "size").join(deleted, "inode_id", "left")


@query("select i.inode_id, f.path, f.name from file f join inode i on i.inode = f.inode", "inode", "file")
def J3_on_inode_text(spark, d):
    return relation(spark, d, "inode").select("inode_id", "inode").join(relation(spark, d, "file").select("inode", "path", "name"), "inode").drop("inode")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def J4_semi(spark, d):
    chosen = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").join(chosen, "o_custkey", "left_semi")


@query("select l.l_orderkey, l.l_linenumber, l.l_partkey, (select o_orderdate from orders where o_orderkey = l.l_orderkey) as packet_time from lineitem l")
def J5_scalar(spark, d):
    times = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("packet_time"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(times, "l_orderkey", "left")


def geo(spark, d):
    """Known addresses and their dimensions."""
    cache = load(spark, d, "customer").selectExpr("167772160 + c_custkey as ip", "c_nationkey as country", "length(c_mktsegment) % 5 as city", "cast(c_custkey % 100 as bigint) as isp", "c_custkey as org")
    dims = {
        "country": load(spark, d, "nation").selectExpr("n_nationkey as id", "n_name as name"),
        "city": load(spark, d, "region").selectExpr("r_regionkey as id", "r_name as name"),
        "isp": load(spark, d, "supplier").selectExpr("s_suppkey as id", "s_name as name"),
        "org": load(spark, d, "part").selectExpr("p_partkey as id", "p_name as name"),
    }
    return cache, dims


_GEO = """with cache as (select 167772160 + c_custkey as ip, c_nationkey as country, length(c_mktsegment) % 5 as city, c_custkey % 100 as isp, c_custkey as org from customer) """


@query(_GEO + "select ip, n_name as country, r_name as city, s_name as isp, p_name as org from cache join nation on n_nationkey = country join region on r_regionkey = city join supplier on s_suppkey = isp join part on p_partkey = org")
def J6_geo_star(spark, d):
    cache, dims = geo(spark, d)
    out = cache
    for name, t in dims.items():
        out = out.join(t.select(F.col("id").alias(name), F.col("name").alias(f"_{name}")), name).drop(name)
    return out.select("ip", *[F.col(f"_{n}").alias(n) for n in dims])


@query("select d.doc_id, upper(md5(d.text)) as md5, coalesce(k.product, '-') as product from documents d left join (select md5(text) as h, min(kind) as product from documents where lang = 'de' and text is not null group by 1) k on k.h = md5(d.text)")
def J7_known_digest(spark, d):
    docs = load(spark, d, "documents")
    known = docs.filter("lang = 'de' and text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("kind").alias("product"))
    hashed = docs.select("doc_id", F.md5("text").alias("h"))
    return hashed.join(known, "h", "left").select("doc_id", F.upper("h").alias("md5"), F.coalesce("product", F.lit("-")).alias("product"))


@query("""with r as (select network, netmask, min(whois_id) as whois_id from whois_routes where whois_id is not null group by 1, 2), a as (select distinct start_ip as ip from whois where start_ip is not null)
select a.ip, arg_max(r.whois_id, r.netmask) as whois_id from a join r on (a.ip & r.netmask) = r.network group by a.ip""")
def J8_longest_prefix(spark, d):
    return lookup.longest_prefix(load(spark, d, "whois"), "start_ip", load(spark, d, "whois_routes"))


@query("select f.inode_id, f.full_name, k.part from (select inode_id, status, concat(path, name) as full_name from file) f join (select distinct status, concat('/', coalesce(kind, 'lost'), '/') as part from inode where lang in ('en', 'de')) k on k.status = f.status where contains(f.full_name, k.part)", "file", "inode")
def J9_contains_join(spark, d):
    files = relation(spark, d, "file").select("inode_id", "status", F.concat("path", "name").alias("full_name"))
    keys = relation(spark, d, "inode").filter("lang in ('en', 'de')").select("status", F.concat(F.lit("/"), F.coalesce("kind", F.lit("lost")), F.lit("/")).alias("part")).distinct()
    return lookup.containing(files, "full_name", keys, "part", "status").drop("status")


@query("select c.inode_id, c.src_ip, p.length from connection_details c join packet p on p.id = c.inode_id where p.length > 90", "connection_details", "packet")
def J10_connection_packet(spark, d):
    p = relation(spark, d, "packet").filter("length > 90").select(F.col("id").alias("inode_id"), "length")
    return relation(spark, d, "connection_details").select("inode_id", "src_ip").join(p, "inode_id")


@query("""select p.stream_id, p.position, (select min(id) from ends e where e.stream_id = p.stream_id and e.e >= p.position) as id
from (select stream_id, cast(k * 1000 as bigint) as position from (select distinct stream_id from packet) s, (values (1), (2), (3)) v(k)) p""".replace("select p.stream_id", "select p.stream_id").replace("from ends", "from (select stream_id, id, sum(length) over (partition by stream_id order by id) as e from packet)"), "packet")
def J11_position_to_packet(spark, d):
    packets = relation(spark, d, "packet")
    ends = running.running(packets, "stream_id", "id", {"e": ("sum", F.col("length"))})
    points = packets.select("stream_id").distinct().select("stream_id", F.explode(F.array(*[F.lit(k * 1000).cast("long") for k in (1, 2, 3)])).alias("position"))
    return lookup.first_reaching(points, "stream_id", "position", ends, "e", "id")


_BOTH = "(select inode_id, src_ip, src_port, dest_ip, dest_port from connection_details where event_type <> 'view' union all select inode_id + 1000000000, dest_ip, dest_port, src_ip, src_port from connection_details where event_type = 'click')"


def _both_ways(spark, d):
    c = relation(spark, d, "connection_details")
    ends = ["inode_id", "src_ip", "src_port", "dest_ip", "dest_port"]
    back = c.filter("event_type = 'click'").selectExpr("inode_id + 1000000000 as inode_id", "dest_ip as src_ip", "dest_port as src_port", "src_ip as dest_ip", "src_port as dest_port")
    return c.filter("event_type <> 'view'").select(*ends).unionByName(back)


@query(f"select a.inode_id, (select min(b.inode_id) from {_BOTH} b where b.src_ip = a.dest_ip and b.src_port = a.dest_port and b.dest_ip = a.src_ip and b.dest_port = a.src_port) as reverse from {_BOTH} a", "connection_details")
def J12_stream_pairs(spark, d):
    return lookup.pairs(_both_ways(spark, d))


@query("select c.inode_id, s.inode_id as control from (select inode_id, src_ip, src_port, dest_ip, dest_port from connection_details where event_type = 'error') c join (select src_ip, src_port, dest_ip, dest_port, min(inode_id) as inode_id from connection_details group by all) s using (src_ip, src_port, dest_ip, dest_port)", "connection_details")
def J13_data_to_control(spark, d):
    c = relation(spark, d, "connection_details")
    ends = ["src_ip", "src_port", "dest_ip", "dest_port"]
    control = c.groupBy(*ends).agg(F.min("inode_id").alias("control"))
    return c.filter("event_type = 'error'").select("inode_id", *ends).join(control, ends).select("inode_id", "control")


@query("select f.name, t.type, i.size from file f, type t, inode i where f.inode_id = t.inode_id and i.inode_id = f.inode_id and i.status = 'alloc'", "file", "type", "inode")
def J14_three_way(spark, d):
    f, t, i = (relation(spark, d, n) for n in ("file", "type", "inode"))
    return f.select("inode_id", "name").join(t.select("inode_id", "type"), "inode_id").join(i.filter("status = 'alloc'").select("inode_id", "size"), "inode_id").drop("inode_id")


@query("""select user_id, max(case when event_type = 'click' then n end) as click, max(case when event_type = 'error' then n end) as error, max(case when event_type = 'view' then n end) as view
from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def J15_pivoted_keys(spark, d):
    return load(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1)))


@query("select h.inode_id, h.word_id, h.pos, w.word_type from hit h join word w on w.word_id = h.word_id where w.class = 'network'", "hit", "word")
def J16_dictionary_hits(spark, d):
    words = relation(spark, d, "word").filter("class = 'network'").select("word_id", "word_type")
    return relation(spark, d, "hit").select("inode_id", "word_id", "pos").join(words, "word_id")


_EDGES = "(select concat('c', cast(c_custkey as string)) as name, concat('n', cast(c_nationkey as string)) as pname, 'no' as link from customer union all select concat('n', cast(n_nationkey as string)), concat('r', cast(n_regionkey as string)), 'yes' from nation)"


@query(f"select distinct e.name, e.pname as next, 'out' as way from {_EDGES} e where e.link = 'yes' union all select distinct e.pname, e.name, 'in' from {_EDGES} e where e.pname like 'r%'")
def J17_graph_steps(spark, d):
    people = load(spark, d, "customer").selectExpr("concat('c', cast(c_custkey as string)) as name", "concat('n', cast(c_nationkey as string)) as pname", "'no' as link")
    places = load(spark, d, "nation").selectExpr("concat('n', cast(n_nationkey as string)) as name", "concat('r', cast(n_regionkey as string)) as pname", "'yes' as link")
    edges = people.unionByName(places)
    out = lookup.graph_step(edges.filter("link = 'yes'"), edges.filter("link = 'yes'")).withColumn("way", F.lit("out"))
    roots = edges.filter(F.col("pname").startswith("r")).select(F.col("pname").alias("name"))
    return out.unionByName(lookup.graph_step(edges, roots, outward=False).withColumn("way", F.lit("in")))


@query("""select a.user_id as packet, b.event_id as answer from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'view' and cast(floor(a.value) as bigint) = cast(floor(b.value) as bigint)""")
def J18_alias_in_packet(spark, d):
    e = load(spark, d, "events").withColumn("name", F.floor("value").cast("long"))
    alias = e.filter("event_type = 'signup'").select("user_id", "name")
    answer = e.filter("event_type = 'view'").select("user_id", "name", F.col("event_id").alias("answer"))
    return alias.join(answer, ["user_id", "name"]).select(F.col("user_id").alias("packet"), "answer")


@query("select e.event_id, replace(coalesce(p.p_name, 'event %1'), '%1', cast(e.event_id as string)) as message from events e left join (select s_suppkey, min(s_nationkey) as f from supplier group by 1) s on s.s_suppkey = e.user_id left join part p on p.p_partkey = s.f")
def J19_message_templates(spark, d):
    source = load(spark, d, "supplier").groupBy(F.col("s_suppkey").alias("user_id")).agg(F.min("s_nationkey").cast("long").alias("f"))
    texts = load(spark, d, "part").select(F.col("p_partkey").alias("f"), "p_name")
    joined = load(spark, d, "events").select("event_id", "user_id").join(source, "user_id", "left").join(texts, "f", "left")
    return joined.select("event_id", F.replace(F.coalesce("p_name", F.lit("event %1")), F.lit("%1"), F.col("event_id").cast("string")).alias("message"))


@query("""select r.event_id, q.event_id as request_event_id, q.value as request_value from (select * from events where event_type <> 'click') r
asof left join (select * from events where event_type = 'click') q on r.user_id = q.user_id and r.event_id > q.event_id""")
def J20_latest_request(spark, d):
    rows = lookup.latest_before(load(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id", "event_type", "click", ["event_id", "value"])
    return rows.select("event_id", "request_event_id", "request_value")


@query("select distinct p.inode_id as id, a.session from connection_details p join (select user_id as session, 1024 + user_id as a_port, 80 as b_port from (select distinct user_id from events where user_id < 60)) a on (p.src_port = a.a_port and p.dest_port = a.b_port) or (p.dest_port = a.a_port and p.src_port = a.b_port)", "connection_details")
def J21_either_ports(spark, d):
    announced = load(spark, d, "events").filter("user_id < 60").select("user_id").distinct().selectExpr("user_id as session", "1024 + user_id as a_port", "80 as b_port")
    packets = relation(spark, d, "connection_details").select(F.col("inode_id").alias("id"), "src_port", "dest_port")
    return lookup.by_either_ports(packets, announced)


@query("""select p.inode_id as id, a.session from connection_details p join (select distinct user_id as session, 1024 + user_id as a_port, 80 as b_port from events) a on p.src_port = a.a_port and p.dest_port = a.b_port
union select p.inode_id, a.session from connection_details p join (select distinct user_id as session, 1024 + user_id as a_port, 80 as b_port from events) a on p.dest_port = a.a_port and p.src_port = a.b_port""", "connection_details")
def J21_all_ports(spark, d):
    """J21_either_ports, whose SQL announces the users under 60 only, with the sessions of all users."""
    announced = load(spark, d, "events").select("user_id").distinct().selectExpr("user_id as session", "1024 + user_id as a_port", "80 as b_port")
    packets = relation(spark, d, "connection_details").select(F.col("inode_id").alias("id"), "src_port", "dest_port")
    return lookup.by_either_ports(packets, announced)


@query("select h.inode_id, h.word_id, h.pos from hit h where h.word_id in (select word_id from word where class = '_carver')", "hit", "word")
def J22_carving_hits(spark, d):
    carver = relation(spark, d, "word").filter("class = '_carver'").select("word_id")
    return relation(spark, d, "hit").select("inode_id", "word_id", "pos").join(carver, "word_id", "left_semi")


def _geo_filter(spark, d, text: str) -> DataFrame:
    cache, dims = geo(spark, d)
    cols = [C.BigIntegerType("inode_id"), lookup.GeoIPType("src_ip", cache=cache, dims=dims)]
    return Q.run(Q.QuerySpec(cols, text, order=None), {"c": relation(spark, d, "connection_details")})


_DOTTED = "concat(cast(src_ip >> 24 as string), '.', cast((src_ip >> 16) & 255 as string), '.', cast((src_ip >> 8) & 255 as string), '.', cast(src_ip & 255 as string))"
_GEO_SQL = "select inode_id, " + _DOTTED + " as src_ip from (select 167772160 + user_id as src_ip, event_id as inode_id from events) where src_ip in (select 167772160 + c_custkey from customer where {0})"


@query(_GEO_SQL.format("c_nationkey in (select n_nationkey from nation where n_name = 'NATION_3')"))
def F21_whois_country(spark, d):
    return _geo_filter(spark, d, "src_ip whois_country nation_3")


@query(_GEO_SQL.format("c_nationkey in (select n_nationkey from nation where n_name = 'NATION_4') or length(c_mktsegment) % 5 in (select r_regionkey from region where r_regionkey = 1)"))
def F21_maxmind_country_city(spark, d):
    name = load(spark, d, "region").filter("r_regionkey = 1").first()["r_name"]
    return _geo_filter(spark, d, f"src_ip maxmind_country NATION_4 or src_ip maxmind_city '{name}'")


@query(_GEO_SQL.format("c_custkey % 100 in (select s_suppkey from supplier where s_name = 'Supplier#000000007') or c_custkey in (select p_partkey from part where lower(p_name) like '%red%')"))
def F21_maxmind_isp_org_like(spark, d):
    return _geo_filter(spark, d, "src_ip maxmind_isp 'Supplier#000000007' or src_ip maxmind_org_like Red")


@query(_GEO_SQL.format("c_custkey % 100 in (select s_suppkey from supplier where s_name like '%0000001%') or c_custkey in (select p_partkey from part where lower(p_name) = 'blue bolt')"))
def F21_maxmind_isp_like_org(spark, d):
    return _geo_filter(spark, d, "src_ip maxmind_isp_like 0000001 or src_ip maxmind_org 'BLUE bolt'")


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("select event_type, count(*) as \"Count\" from events where value > 20 group by 1")
def A1_group_count(spark, d):
    cols = [C.StringType("event_type"), C.FloatType("value")]
    return Q.run(Q.QuerySpec(cols, "value > 20", group=0), {"events": load(spark, d, "events")})


@query("select count(*) as total from events where value > 20 and event_type = 'view'")
def A2_total(spark, d):
    cols = [C.StringType("event_type"), C.FloatType("value")]
    return Q.count(Q.QuerySpec(cols, "value > 20 and event_type = view"), {"events": load(spark, d, "events")})


@query("select inode_id, min(pos) as pos, min(word_id) as word_id from (select inode_id, pos, word_id, rank() over (partition by inode_id order by pos) as k from hit where word_id is not null) where k = 1 group by 1", "hit")
def A3_one_hit_per_inode(spark, d):
    hits = relation(spark, d, "hit").filter("word_id is not null")
    return hits.groupBy("inode_id").agg(F.min(F.struct("pos", "word_id")).alias("m")).select("inode_id", "m.pos", "m.word_id")


@query("select distinct mime, type from type", "type")
def A4_distinct_types(spark, d):
    return relation(spark, d, "type").select("mime", "type").distinct()


@query("select distinct country, status from whois")
def A5_select_distinct(spark, d):
    return load(spark, d, "whois").select("country", "status").distinct()


@query("select cast(floor(epoch(ts) / 3600) * 3600 as bigint) as bin, cast(sum(length) as bigint) as total from packet group by 1", "packet")
def A6_bandwidth(spark, d):
    return analytics.bandwidth(relation(spark, d, "packet"), "ts", "length", 3600)


@query("select cast(floor(epoch(ts) / 60) * 60 as bigint) as bin, cast(sum(length) as bigint) as total from packet where ts >= timestamp '2024-01-03 00:00:00' and ts < timestamp '2024-01-03 01:40:00' group by 1", "packet")
def A6_bandwidth_graph(spark, d):
    return analytics.bandwidth(relation(spark, d, "packet"), "ts", "length", 60, "2024-01-03 00:00:00", 100)


@query("""select time, name, min(key) as key, cast(sum(m) as bigint) as m, cast(sum(a) as bigint) as a from (
select o_orderdate as time, o_orderpriority as name, o_orderkey as key, 1 as m, 0 as a from orders union all
select l_shipdate, o_orderpriority, o_orderkey, 0, 1 from lineitem join orders on o_orderkey = l_orderkey where l_shipdate is not null) group by 1, 2""")
def A7_timeline(spark, d):
    first = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("a"))
    both = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("m"), F.lit(None).cast("timestamp_ntz").alias("a"))
    shipped = first.join(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select("o_orderkey", "o_orderpriority", F.lit(None).cast("timestamp_ntz").alias("m"), "a")
    return analytics.timeline(both.unionByName(shipped), {"m": "m", "a": "a"}, "o_orderpriority", "o_orderkey")


@query("select count(*) as objects, cast(sum(o_orderkey % 1000) as bigint) as bytes from orders where ((case when o_orderstatus = 'F' then o_custkey + 1073741824 else o_custkey end) & 1073741823) < 700")
def A8_outdated(spark, d):
    inodes = load(spark, d, "orders").selectExpr("case when o_orderstatus = 'F' then o_custkey + 1073741824 else o_custkey end as version", "o_orderkey % 1000 as size")
    return analytics.outdated(inodes, "version", "size", 700)


@query("select src_ip, count(*) as n from connection_details group by 1", "connection_details")
def A9_addresses(spark, d):
    return relation(spark, d, "connection_details").groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


@query("""select stream_id, count(*) as packets, round(corr(i, t), 6) as r_jitter, round(regr_slope(i, t), 6) as rate, round(corr(o, t), 6) as r_data, round(regr_slope(o, t) * 8 / 1000, 6) as kbits
from (select stream_id, epoch_us(ts) / 1e6 - 1704067200 as t, row_number() over w as i, sum(length) over w as o from packet window w as (partition by stream_id order by id)) group by 1""", "packet")
def A10_stream_statistics(spark, d):
    r = analytics.stream_statistics(relation(spark, d, "packet").withColumn("ts", (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200_000_000).cast("long")).withColumn("ts", F.timestamp_micros("ts")))
    return r.select("stream_id", "packets", *[F.round(c, 6).alias(c) for c in ("r_jitter", "rate", "r_data", "kbits")])


@query("select min(id) as lowest, max(id) as highest, count(*) as n from whois")
def A11_dashboard(spark, d):
    return load(spark, d, "whois").agg(F.min("id").alias("lowest"), F.max("id").alias("highest"), F.count(F.lit(1)).alias("n"))


@query("select 'whois' as tbl, count(*) as rows from whois union all select 'tree', count(*) from tree union all select 'events', count(*) from events")
def A12_signature(spark, d):
    return analytics.signature({n: load(spark, d, n) for n in ("whois", "tree", "events")})


@query("select inode_id, word_id, count(*) as n from hit group by 1, 2", "hit")
def A13_hits_per_object(spark, d):
    return relation(spark, d, "hit").groupBy("inode_id", "word_id").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) as count from inode where status = 'alloc' and kind = 'mail' group by 1", "inode")
def A14_drill_down(spark, d):
    return analytics.drill_down(relation(spark, d, "inode"), ["status", "kind", "lang"], ["alloc", "mail"])


@query("select event_type as what, count(*) as n from events where event_type in ('click', 'view', 'error', 'signup') group by 1")
def A15_network_summary(spark, d):
    return load(spark, d, "events").filter(F.col("event_type").isin("click", "view", "error", "signup")).groupBy(F.col("event_type").alias("what")).agg(F.count(F.lit(1)).alias("n"))


# ---- windows --------------------------------------------------------------------------------------------------------


@query("select id, stream_id, row_number() over (partition by stream_id order by id) as n from packet", "packet")
def W1_row_number(spark, d):
    return running.running(relation(spark, d, "packet").select("id", "stream_id"), "stream_id", "id", {"n": ("count", F.lit(1))})


@query("select event_id, user_id, cast((dense_rank() over (order by user_id) - 1) % 2 as int) as band from events")
def W2_banding(spark, d):
    return analytics.banded(load(spark, d, "events").select("event_id", "user_id"), "user_id", "user_id", ("event_id",))


@query("select page, count(*) as rows, min(value) as start_value, max(value) as end_value from (select value, cast(ceil(row_number() over (order by value, event_id) / 50.0) as bigint) as page from events) group by 1")
def W3_pages(spark, d):
    return analytics.page_ends(analytics.paged(load(spark, d, "events").select("event_id", "value"), "value", 50, ("event_id",)), "value")


@query("select event_id, last_value(case when event_type <> 'error' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as carried from events")
def W4_carry_forward(spark, d):
    rows = running.running(load(spark, d, "events"), "user_id", "event_id", {"carried": ("before", F.when(F.col("event_type") != "error", F.col("event_id")))})
    return rows.select("event_id", "carried")


@query("select id, stream_id, cast(sum(length) over (partition by stream_id order by id) - length as bigint) as position from packet", "packet")
def W5_combined_position(spark, d):
    return flows.combined(relation(spark, d, "packet"), "stream_id", "id", "length").select("id", "stream_id", "position")


@query("""select event_id, cast(unnest(range(0, coalesce(n, 0) + 1)) as int) as copy from (select event_id, t, lead(t) over (partition by user_id order by event_id) as n from (
select event_id, user_id, case when event_type = 'error' then cast(floor(value) as bigint) % 4 end as t from events)) where t is null""")
def W6_repeats(spark, d):
    rows = load(spark, d, "events").withColumn("times", F.when(F.col("event_type") == "error", F.floor("value").cast("int") % 4))
    return logs.repeated(rows, "user_id", "event_id", "times").select("event_id", F.col("copy").cast("int").alias("copy"))


# ---- sets -----------------------------------------------------------------------------------------------------------


@query("select o_orderkey as id, o_orderdate as time, 'm' as kind from orders union all select l_orderkey, l_shipdate, 'a' from lineitem")
def U1_union_all(spark, d):
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time"), F.lit("m").alias("kind"))
    return a.unionByName(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("time"), F.lit("a").alias("kind")))


@query("select cast(s_suppkey as string) as id, s_name as name from supplier union all select cast(c_custkey as string), c_name from customer union all select cast(n_nationkey as string), n_name from nation")
def U2_many_sources(spark, d):
    parts = [load(spark, d, t).select(F.col(k).cast("string").alias("id"), F.col(n).alias("name")) for t, k, n in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select distinct ftp_session_id from ftp_commands where ftp_session_id is not null and ftp_session_id not in (select inode_id from ftp_sessions where inode_id is not null)")
def U3_not_present(spark, d):
    known = load(spark, d, "ftp_sessions").select(F.col("inode_id").alias("ftp_session_id"))
    return load(spark, d, "ftp_commands").filter("ftp_session_id is not null").select("ftp_session_id").distinct().join(known, "ftp_session_id", "left_anti")


@query("select id, min(netname) as netname from whois group by 1")
def U4_insert_ignore(spark, d):
    return load(spark, d, "whois").groupBy("id").agg(F.min("netname").alias("netname"))


# ---- flows ----------------------------------------------------------------------------------------------------------


@query("with cd as (select event_id as inode_id, 167772160 + user_id as src_ip, 3232235776 + cast(length(event_type) as bigint) as dest_ip, cast(1024 + user_id as int) as src_port, case event_type when 'view' then 80 when 'click' then 443 when 'error' then 25 else 21 end as dest_port, event_type from events), " + """b as (select inode_id as event_id, src_ip, src_port, dest_ip, dest_port from """ + _BOTH.replace("connection_details", "cd") + """), k as (select *, case when src_ip > dest_ip or (src_ip = dest_ip and src_port > dest_port) then concat(dest_ip, ':', dest_port, '-', src_ip, ':', src_port) else concat(src_ip, ':', src_port, '-', dest_ip, ':', dest_port) end as flow from b)
select flow, count(*) as packets, min(event_id) as first, max(event_id) as last, arg_min(src_ip, event_id) as src_ip, arg_min(src_port, event_id) as src_port, arg_min(dest_ip, event_id) as dest_ip, arg_min(dest_port, event_id) as dest_port from k group by 1""")
def T1_flow_table(spark, d):
    return flows.flow_table(_both_ways(spark, d).withColumnRenamed("inode_id", "event_id"))


_SEG = "(select user_id as stream, event_id as id, cast(floor(value * 7) as bigint) as seq, cast(floor(value) as bigint) + 40 as len from events)"


@query(f"""select id, stream, greatest(seq, coalesce(seen, seq)) as new_seq, greatest(seq + len - greatest(seq, coalesce(seen, seq)), 0) as new_length
from (select *, max(seq + len) over (partition by stream order by id rows between unbounded preceding and 1 preceding) as seen from {_SEG})""")
def T3_trimmed(spark, d):
    seg = load(spark, d, "events").selectExpr("user_id as stream", "event_id as id", "cast(floor(value * 7) as bigint) as seq", "cast(floor(value) as bigint) + 40 as len")
    return flows.trimmed(seg, "stream", "id", "seq", "len").select("id", "stream", "new_seq", "new_length")


@query("select id, stream_id, cast(sum(case when g is null or g > 300 then 1 else 0 end) over (partition by stream_id order by id) as bigint) as session from (select id, stream_id, id - lag(id) over (partition by stream_id order by id) as g from packet)", "packet")
def T5_sessions(spark, d):
    return flows.sessions(relation(spark, d, "packet").select("id", "stream_id"), "stream_id", "id", 300)


def _segments(spark, d):
    seg = load(spark, d, "events").selectExpr("user_id as stream", "event_id as id", "cast(floor(value * 3) as bigint) as seq", "cast(event_type as binary) as data")
    return flows.sessions(seg, "stream", "id", 2000)


@query()
def T2_reassembled(spark, d):
    """Ordering, gaps, overlaps, lifecycle and the final flush of TCP streams."""
    return flows.reassembled(_segments(spark, d))


@query()
def T7_datagrams(spark, d):
    return flows.datagrams(_segments(spark, d))
