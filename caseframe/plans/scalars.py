"""Scalar functions (X) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseframe.functions import dates, net, text
from caseframe.operators import analytics, lookup
from caseframe.plans.registry import query, relation
from caseframe.session import load

_DOT = "concat(cast({0} >> 24 as string), '.', cast(({0} >> 16) & 255 as string), '.', cast(({0} >> 8) & 255 as string), '.', cast({0} & 255 as string))"


@query("select inode_id, " + _DOT.format("src_ip") + " as quad, src_ip as back, cast(null as bigint) as bad from connection_details", "connection_details")
def X1_addresses(spark, d):
    c = relation(spark, d, "connection_details").select("inode_id", net.long_to_ip(F.col("src_ip")).alias("quad"))
    return c.select("inode_id", "quad", net.ip_to_long(F.col("quad")).alias("back"), net.ip_to_long(F.concat("quad", F.lit(".1"))).alias("bad"))


@query("select inode_id from connection_details where src_ip between 167772161 and 167837695 and dest_ip between 3232235776 and 3232301311", "connection_details")
def X3_cidr(spark, d):
    a, b = net.parse_cidr("10.0.0.1/16"), net.parse_cidr("192.168.1.0/16")
    return relation(spark, d, "connection_details").filter(F.col("src_ip").between(*a) & F.col("dest_ip").between(*b)).select("inode_id")


@query("select o_orderkey, o_orderdate as a, o_orderdate as b, o_orderdate as c, cast(null as timestamp) as bad from orders")
def X4_date_guess(spark, d):
    o = load(spark, d, "orders")
    day = lambda form: dates.guess_column(F.date_format("o_orderdate", form)).cast("timestamp_ntz")
    return o.select("o_orderkey", day("yyyy-MM-dd HH:mm:ss").alias("a"), day("d MMM yyyy").alias("b"), day("dd/MM/yyyy").alias("c"), dates.guess_column(F.lit("no date")).cast("timestamp_ntz").alias("bad"))


@query("select event_id, date_trunc('second', ts) as at from events")
def X5_default_year(spark, d):
    return load(spark, d, "events").select("event_id", dates.with_year(F.date_format("ts", "MMM d HH:mm:ss"), "MMM d HH:mm:ss", 2024).cast("timestamp_ntz").alias("at"))


@query("select event_id, date_trunc('second', ts) + interval 9 hour as tokyo from events")
def X6_time_zones(spark, d):
    return load(spark, d, "events").select("event_id", dates.convert_zone(F.date_trunc("second", F.col("ts").cast("timestamp")), "UTC", "Asia/Tokyo").cast("timestamp_ntz").alias("tokyo"))


@query("select event_id, cast(floor(epoch(ts)) as bigint) as seconds, date_trunc('second', ts) as again, date_trunc('second', ts) as filetime from events")
def X7_epochs(spark, d):
    e = load(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("seconds"))
    return e.select("event_id", "seconds", F.timestamp_seconds("seconds").cast("timestamp_ntz").alias("again"), dates.from_filetime((F.col("seconds") + 11_644_473_600) * 10_000_000).cast("timestamp_ntz").alias("filetime"))


@query("select event_id, cast(floor(epoch(ts) / 300) * 300 as bigint) as bin from events")
def X8_bins(spark, d):
    return load(spark, d, "events").select("event_id", dates.bin_start(F.col("ts"), 300).alias("bin"))


@query("select inode_id, concat(path, name) as full_name, concat_ws(',', status, inode) as joined from file", "file")
def X9_concat(spark, d):
    return relation(spark, d, "file").select("inode_id", F.concat("path", "name").alias("full_name"), F.concat_ws(",", "status", "inode").alias("joined"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'type,hash' else concat('type,hash,', o_orderstatus) end as added, case when o_orderstatus = 'F' then 'type' else concat('type,', o_orderstatus) end as removed from orders")
def X10_sets(spark, d):
    base = F.array(F.lit("type"), F.lit("hash"))
    added = F.when(F.col("o_orderstatus") == "F", text.set_add(base, F.lit("type"))).otherwise(text.set_add(base, F.col("o_orderstatus")))
    o = load(spark, d, "orders").select("o_orderkey", added.alias("s"))
    return o.select("o_orderkey", F.array_join("s", ",").alias("added"), F.array_join(text.set_remove(F.col("s"), "hash"), ",").alias("removed"))


@query("select substr(p_name, 1, 1) as initial, count(*) as n, min(left(p_name, 3)) as first3 from part group by 1")
def X11_prefixes(spark, d):
    return load(spark, d, "part").groupBy(F.substring("p_name", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("n"), F.min(F.left("p_name", F.lit(3))).alias("first3"))


@query("""select inode_id, case when host like '%.example.org' then 'example.org' when host like '%.com.au' then split_part(host, '.', 2) || '.com.au' else split_part(host, '.', 2) || '.co.uk' end as domain from http""", "http")
def X12_registrable_domain(spark, d):
    return relation(spark, d, "http").select("inode_id", net.registrable_domain(F.col("host")).alias("domain"))


@query("select inode_id, host from http", "http")
def X13_url_host(spark, d):
    return relation(spark, d, "http").select("inode_id", net.url_host(F.col("url")).alias("host"))


@query("select id, regexp_replace(netname, '[^a-zA-Z0-9]', '_', 'g') as table_name from whois where netname is not null")
def X14_table_names(spark, d):
    return load(spark, d, "whois").filter("netname is not null").select("id", text.table_name(F.col("netname")).alias("table_name"))


@query("select p_partkey, p_name like 'r%_ng' as a, regexp_matches(p_name, '^[^/]*[rb]olt$') as b from part")
def X15_globs(spark, d):
    return load(spark, d, "part").select("p_partkey", F.col("p_name").like(text.glob_like("r*?ng")).alias("a"), F.col("p_name").rlike(text.glob_regex("*[rb]olt")).alias("b"))


@query("select inode_id, concat('/', trim(path, '/'), '/', name) as normal, name as last, len(string_split(trim(path, '/'), '/')) + 1 as depth from file", "file")
def X16_paths(spark, d):
    f = relation(spark, d, "file").select("inode_id", F.concat(F.lit("/"), F.regexp_replace("path", "/", "//"), "name").alias("raw"))
    parts = text.path_parts(F.col("raw"))
    return f.select("inode_id", text.normal_path(F.col("raw")).alias("normal"), F.element_at(parts, -1).alias("last"), F.size(parts).cast("long").alias("depth"))


@query("select o_orderkey, o_orderkey as plain, o_orderkey * 1024 as kilo, o_orderkey as hexa, o_orderkey * 512 as sectors, cast(null as bigint) as bad from orders")
def X17_sizes(spark, d):
    k = F.col("o_orderkey").cast("string")
    size = text.size_value
    return load(spark, d, "orders").select("o_orderkey", size(k).alias("plain"), size(F.concat(k, F.lit("K"))).alias("kilo"), size(F.concat(F.lit("0x"), F.hex("o_orderkey"))).alias("hexa"), size(F.concat(k, F.lit("s"))).alias("sectors"), size(F.concat(k, F.lit(" bytes"))).alias("bad"))


@query("select doc_id, upper(md5(text)) as md5 from documents where octet_length(encode(text)) >= 16")
def X18_digests(spark, d):
    return load(spark, d, "documents").filter(F.octet_length("text") >= 16).select("doc_id", F.upper(F.md5("text")).alias("md5"))


@query("select o_orderkey, o_orderkey & 255 as low, o_orderkey | 1024 as marked, o_orderkey & ~15 as aligned from orders")
def X19_bits(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", k.bitwiseAND(255).alias("low"), k.bitwiseOR(1024).alias("marked"), k.bitwiseAND(F.bitwise_not(F.lit(15).cast("long"))).alias("aligned"))


@query("select inode_id, 'Order ' || cast(inode_id as string) || ' & more' as title, url as link from http", "http")
def X20_html(spark, d):
    page = F.concat(F.lit("<html><head><title>Order "), F.col("inode_id").cast("string"), F.lit(" &amp; more</title></head><body><a class=x href='"), F.col("url"), F.lit("'>go</a></body></html>"))
    from caseframe.operators import scanners

    return relation(spark, d, "http").select("inode_id", scanners.html_title(page).alias("title"), scanners.html_links(page)[0].alias("link"))


@query("select inode_id, 'q' as key, concat(split_part(split_part(url, '?q=', 2), '+', 1), ' ', split_part(split_part(url, '+', 2), '&', 1)) as value from http union all select inode_id, 'page', split_part(url, '&page=', 2) from http", "http")
def X21_parameters(spark, d):
    return relation(spark, d, "http").select("inode_id", F.explode(net.query_parameters(F.col("url"))).alias("p")).select("inode_id", "p.key", "p.value")


@query()
def X22_pseudonyms(spark, d):
    c = relation(spark, d, "connection_details").select("inode_id", F.concat(net.long_to_ip(F.col("src_ip")), F.lit(" -> "), net.long_to_ip(F.col("dest_ip"))).alias("line"))
    return c.select("inode_id", analytics.anonymised(F.col("line"), "seed").alias("line"))


@query("select id, left(regexp_replace(descr, '[^ -~]', '', 'g'), 20) as label from whois where descr is not null")
def X23_labels(spark, d):
    return load(spark, d, "whois").filter("descr is not null").select("id", text.label(F.col("descr")).alias("label"))


@query("""select doc_id, pos, substr(text, greatest(pos - 20, 0) + 1, pos - greatest(pos - 20, 0) + 3 + 50) as preview
from (select doc_id, text, cast(strpos(text, 'the') - 1 as int) as pos from documents where contains(text, 'the'))""")
def X24_previews(spark, d):
    rows = load(spark, d, "documents").filter(F.col("text").contains("the")).select("doc_id", "text", (F.instr("text", "the") - 1).alias("pos"))
    return rows.select("doc_id", "pos", text.preview(F.col("text"), F.col("pos"), F.lit(3)).alias("preview"))


@query("""with recursive r(id, pos, stop, network, bits) as (
  select distinct id, start_ip, start_ip + numhosts, cast(null as bigint), cast(null as int) from whois where start_ip is not null and numhosts between 1 and 4096
  union all
  select id, pos + pow(2, k)::bigint, stop, pos, cast(32 - k as int) from (
    select id, pos, stop, list_max(list_filter(range(0, 33), lambda b: pos % pow(2, b)::bigint = 0 and pos + pow(2, b)::bigint <= stop)) as k from r where pos < stop))
select distinct id, network, bits from r where network is not null""")
def X27_cidr_blocks(spark, d):
    w = load(spark, d, "whois").filter("start_ip is not null and numhosts > 0").select(F.col("id"), "start_ip", "numhosts").distinct()
    return w.select("id", F.explode(net.cidr_blocks(F.col("start_ip"), F.col("numhosts"))).alias("b")).select("id", "b.network", "b.bits").distinct()


@query()
def X27_routes(spark, d):
    return lookup.routes_of(load(spark, d, "whois").filter("start_ip is not null and numhosts > 0").distinct(), "start_ip", "numhosts", "id")


@query("select id, netname, concat_ws(' ', adminc, techc, 'more of it') as contact from (select distinct id, trim(netname) as netname, trim(adminc) as adminc, trim(techc) as techc from whois where netname is not null and netname <> '' and adminc is not null and techc is not null and not contains(netname, chr(10)))")
def X28_records(spark, d):
    w = load(spark, d, "whois").filter("netname is not null and netname <> '' and adminc is not null and techc is not null and not contains(netname, '\\n')").select("id", F.trim("netname").alias("netname"), F.trim("adminc").alias("adminc"), F.trim("techc").alias("techc")).distinct()
    record = F.concat(F.lit("inetnum: x\nnetname:   "), "netname", F.lit("\ncontact: "), "adminc", F.lit("\ncontact: "), "techc", F.lit("\n  more of it\nsource: z"))
    return w.select("id", text.first_record_field(record, "netname").alias("netname"), text.record_field(record, "contact").alias("contact"))


@query("select event_id, 'x-kind' as key, concat(event_type, ': ', cast(user_id as string)) as value from events")
def X29_headers(spark, d):
    line = F.concat(F.lit("X-Kind:  "), F.col("event_type"), F.lit(": "), F.col("user_id").cast("string"), F.lit(" "))
    return load(spark, d, "events").select("event_id", net.header_pair(line).alias("h")).select("event_id", "h.key", "h.value")
