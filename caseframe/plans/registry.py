"""Registered queries of the reference operators, each beside its SQL; and relations that both engines derive alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseframe.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Relations of a case derived from the given tables: (table, select list in SQL that both engines read).
RELATIONS: dict[str, tuple[str, list[str]]] = {
    "inode": ("documents", [
        "doc_id as inode_id", "concat('I', coalesce(source, 'none'), '|D', cast(doc_id as string)) as inode",
        "case when kind is null then 'deleted' else 'alloc' end as status", "coalesce(n_chars, 0) as size", "loaded as mtime", "kind", "lang",
    ]),
    "file": ("documents", [
        "doc_id as inode_id", "concat('I', coalesce(source, 'none'), '|D', cast(doc_id as string)) as inode",
        "concat('/', coalesce(kind, 'lost'), '/', coalesce(nullif(lang, ''), 'xx'), '/') as path",
        "concat('doc', cast(doc_id as string), case kind when 'mail' then '.eml' when 'page' then '.html' else '.txt' end) as name",
        "case when kind is null then 'deleted' else 'alloc' end as status",
    ]),
    "type": ("documents", [
        "doc_id as inode_id", "case kind when 'mail' then 'message/rfc822' when 'page' then 'text/html' else 'text/plain' end as mime",
        "case kind when 'mail' then 'RFC 822 mail text' when 'page' then 'HTML document text' when 'chat' then 'chat transcript' else 'plain text' end as type",
    ]),
    "annotate": ("area_labels", ["doc_id as inode_id", "area as note", "'Note' as category"]),
    "http": ("events", [
        "event_id as inode_id", "case event_type when 'purchase' then 'POST' else 'GET' end as method",
        "concat('www.site', cast(user_id as string), case when user_id < 50 then '.com.au' when user_id < 100 then '.example.org' else '.co.uk' end) as host",
        "concat('http://www.site', cast(user_id as string), case when user_id < 50 then '.com.au' when user_id < 100 then '.example.org' else '.co.uk' end, '/', event_type, '?q=', event_type, '+', cast(user_id as string), '&page=', cast(event_id as string)) as url",
        "case event_type when 'error' then 404 else 200 end as status",
        "case event_type when 'view' then 'image/jpeg' when 'click' then 'text/html; charset=utf-8' when 'signup' then 'video/mpeg' else 'text/html' end as content_type",
        "ts as date",
    ]),
    "packet": ("events", ["event_id as id", "ts", "user_id as stream_id", "cast(floor(value) as bigint) + 40 as length"]),
    "connection_details": ("events", [
        "event_id as inode_id", "167772160 + user_id as src_ip", "3232235776 + cast(length(event_type) as bigint) as dest_ip", "cast(1024 + user_id as int) as src_port",
        "case event_type when 'view' then 80 when 'click' then 443 when 'error' then 25 else 21 end as dest_port", "ts as ts_sec", "user_id", "event_id", "event_type", "value",
    ]),
    "hit": ("logicalindexoffsets", ["inode_id", "cast(word_id as bigint) as word_id", "\"offset\" as pos", "cast(\"length\" as int) as len"]),
    "word": ("dictionary", ["cast(id as bigint) as word_id", "class", "type as word_type", "loaded"]),
    "session": ("ftp_sessions", ["inode_id", "client_ip", "server_ip", "username", "total_bytes", "start_time", "inode"]),
    "command": ("ftp_commands", ["inode_id", "ftp_session_id", "command_type", "command", "data", "timestamp as ts"]),
}


def relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    table, exprs = RELATIONS[name]
    return load(spark, d, table).selectExpr(*[e.replace('"', "`") for e in exprs])


def relations_sql(*names: str) -> str:
    return "with " + ", ".join(f"{n} as (select {', '.join(RELATIONS[n][1])} from {RELATIONS[n][0]})" for n in names)


def query(sql: str | None = None, *relations: str) -> Callable:
    """Registers a query under its function's name, with SQL over the tables and the named relations."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{relations_sql(*relations)} {sql}" if relations else sql
        return f

    return keep
