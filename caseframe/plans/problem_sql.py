"""The queries of the general problems in SQL, for the comparison with another engine. Without an entry: p1, whose free
notations SQL can't express (tested against a plain reader)."""

_HITS = "with h as (select distinct inode_id, cast(word_id as bigint) as word_id, \"offset\", \"length\", loaded from logicalindexoffsets)"
_TREE = """with recursive n as (
  select id, min(case when parent <> 0 then parent end) as parent, min(name) as name from tree where id is not null group by id),
l as (select n.id, p.id as parent, n.name from n left join n p on p.id = n.parent),
r as (
  select id, id as root, 0 as depth, '/' || coalesce(name, '') as path from l where parent is null
  union all
  select l.id, r.root, r.depth + 1, r.path || '/' || coalesce(l.name, '') from l join r on l.parent = r.id)"""
_UP = """, a as (
  select l.parent as id, l.id as descendant, 1 as distance from l join r on r.id = l.id where l.parent is not null
  union all
  select l.parent, a.descendant, a.distance + 1 from a join l on l.id = a.id where l.parent is not null)"""
_REFS = """with t as (
  select 'whois' as target, cast(id as bigint) as id, min(loaded) as born from whois group by 2
  union all select 'whois_sources', cast(id as bigint), timestamp '0001-01-01 00:00:00' from whois_sources group by 2
  union all select 'dictionary', cast(id as bigint), min(loaded) from dictionary group by 2
  union all select 'ftp_sessions', inode_id, min(loaded) from ftp_sessions group by 2),
f as (
  select 'whois_routes' as tbl, 'whois' as target, cast(whois_id as bigint) as ref_id, loaded from whois_routes
  union all select 'whois', 'whois_sources', src_id, loaded from whois
  union all select 'logicalindexoffsets', 'dictionary', word_id, loaded from logicalindexoffsets
  union all select 'ftp_commands', 'ftp_sessions', ftp_session_id, loaded from ftp_commands),
o as (
  select f.tbl, f.target, f.ref_id, strftime(f.loaded, '%Y-%m') as period, count(*) as refs, max(t.id) is null as absent
  from f left join t on t.target = f.target and t.id = f.ref_id where f.ref_id is not null
  group by 1, 2, 3, 4 having max(t.id) is null or min(f.loaded) < min(t.born)),
q as (select o.tbl, o.ref_id, o.period, o.refs, case when o.absent then 'absent' else 'later' end as state,
  exists (select 1 from purged p where p.tbl = o.target and p.key_id = o.ref_id) as purged from o)"""

_ORPHAN_REFS = f"""{_REFS},
d as (
  select 'whois_routes' as tbl, 'whois' as target, cast(whois_id as bigint) as ref_id, loaded from (select distinct * from whois_routes)
  union all select 'whois', 'whois_sources', src_id, loaded from (select distinct * from whois)
  union all select 'logicalindexoffsets', 'dictionary', word_id, loaded from (select distinct * from logicalindexoffsets)
  union all select 'ftp_commands', 'ftp_sessions', ftp_session_id, loaded from (select distinct * from ftp_commands)),
g as (
  select d.tbl, d.ref_id, strftime(d.loaded, '%Y-%m') as period, count(*) as orphan_refs, case when t.id is null then 'absent' else 'later' end as state,
    exists (select 1 from purged p where p.tbl = d.target and p.key_id = d.ref_id) as purged
  from d left join t on t.target = d.target and t.id = d.ref_id
  where d.ref_id is not null and (t.id is null or d.loaded is null and t.born > timestamp '0001-01-01 00:00:00' or d.loaded < t.born)
  group by d.tbl, d.target, d.ref_id, 3, 5)"""


def _per(key: str, value: str, n: str, top: str) -> str:
    return f"""{_HITS}, w as (select {key}, {value}, count(*) as c from h where {key} is not null group by 1, 2),
m as (select {key}, {value} as v, c from (select *, row_number() over (partition by {key} order by c desc, {value}) as k from w where {value} is not null) where k = 1)
select h.{key}, count(*) as hits, count(distinct h.{value}) as {n}, min("offset") as first_offset, max("offset") as last_offset, max(m.v) as top_{top}, max(m.c) as top_hits
from h left join m on m.{key} = h.{key} where h.{key} is not null group by h.{key}"""


SQL = {
    "p2_by_word": _per("word_id", "inode_id", "inodes", "inode"),
    "p2_by_inode": _per("inode_id", "word_id", "words", "word"),
    "p2_offset_percentiles": """select cast(word_id as bigint) as word_id, quantile_disc("offset", 0.25) as p25, quantile_disc("offset", 0.5) as p50, quantile_disc("offset", 0.75) as p75
from logicalindexoffsets where word_id is not null and "offset" is not null group by 1""",
    "p2_found": """select 'word_id' as key_field, cast(word_id as bigint) as key_id from logicalindexoffsets where word_id is not null group by 2
having count(*) >= 0.01 * (select count(*) from logicalindexoffsets)
union all select 'inode_id', inode_id from logicalindexoffsets where inode_id is not null group by 2
having count(*) >= 0.01 * (select count(*) from logicalindexoffsets)""",
    "p3_hierarchy": f"{_TREE} select cast(id as bigint) as id, cast(root as bigint) as root, depth, path from r",
    "p3_descendants": f"{_TREE}{_UP} select cast(id as bigint) as id, cast(descendant as bigint) as descendant, distance from a",
    "p3_found": f"{_TREE} select cast(id as bigint) as id from l where id not in (select id from r)",
    "p6_orphans": f"{_REFS} select * from q",
    "p6_report": f"{_REFS} select tbl, period, count(*) as orphan_keys, cast(sum(refs) as bigint) as refs, cast(sum(purged::int) as bigint) as purged_keys from q group by 1, 2",
    "p6_orphan_references": f"{_ORPHAN_REFS} select * from g",
    "p6_reference_report": f"{_ORPHAN_REFS} select tbl, period, count(*) as orphan_keys, cast(sum(orphan_refs) as bigint) as orphan_refs, cast(sum(purged::int) as bigint) as purged_keys from g group by 1, 2",
    "p6_found": f"{_REFS} select tbl, ref_id, period from q",
}
