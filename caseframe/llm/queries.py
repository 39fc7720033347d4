"""Queries of the text problems (p4, p5, p7, p8, p9) and their SQL. Each covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.llm import bpe, mojibake, packing, subjects, terms
from caseframe.session import Stages, load


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled fields of whois with their text as it stands and, where a reading was found, the original."""
    return mojibake.garbled(load(spark, d, "whois"), "id", ["netname", "descr", "remarks"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("id", "field").distinct()


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    hits = load(spark, d, "logicalindexoffsets").select("inode_id", "word_id", "offset", "length", "loaded")
    freq = terms.frequencies(hits, load(spark, d, "dictionary"), load(spark, d, "logicalindexstats"))
    return freq.withColumn("marks", terms.marks(freq, terms.record_count(hits)))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Hits, distinct inodes, recorded hits and marks of every dictionary term."""
    return _frequencies(spark, d).withColumn("marks", F.array_join("marks", ","))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("term", F.explode("marks").alias("mark"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(load(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = bpe.token_counts(load(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sized, load(spark, d, "containers"))


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of each of its parts if it is larger than the capacity."""
    return _packed(spark, d).select("container", "doc_id", "part", "tokens", "bin")


def p8_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Bins used, the bound below which no packing can go, and the share of space that is filled."""
    return packing.certificate(_packed(spark, d))


def p8_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: documents that lie in it completely, and counts of what must not be."""
    sized = Stages(spark, "sized").write(bpe.token_counts(load(spark, d, "documents"), "doc_id", "text"))
    containers = load(spark, d, "containers")
    return packing.properties(packing.pack(sized, containers), sized, containers)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(load(spark, d, "documents"), load(spark, d, "area_labels"), load(spark, d, "subject_areas"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents about each area and their share of all documents."""
    docs = load(spark, d, "documents")
    total = docs.count()
    found = subjects.subjects(docs, load(spark, d, "area_labels"), load(spark, d, "subject_areas")).groupBy("area").agg(F.count(F.lit(1)).alias("docs"))
    areas = load(spark, d, "subject_areas").select("area").distinct()
    return areas.join(found, "area", "left").select("area", F.coalesce("docs", F.lit(0)).alias("docs"), F.round(F.coalesce("docs", F.lit(0)) / F.lit(max(1, total)), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p4_restored, p4_found, p5_terms, p5_found, p7_ids, p8_bins, p8_certificate, p8_properties, p9_found, p9_shares)}
# The words of the given dictionary are Latin-1 letters in UTF-16LE, UTF-8 or one byte each, so that zero bytes can be dropped.
_TERMS = """with b as (select cast(id as bigint) as id, list_transform(range(0, octet_length(word)), lambda i: substr(hex(word), cast(2 * i + 1 as int), 2)) as x from dictionary where word is not null and id is not null),
z as (select id, list_filter(x, lambda v: v <> '00') as nz, len(x) % 2 = 0 and len(x) >= 4 and 2 * len(list_filter(range(1, len(x), 2), lambda i: x[i + 1] = '00')) > len(x) // 2 as wide from b),
s as (select id, case when not wide and try(decode(unhex(array_to_string(nz, '')))) is not null then decode(unhex(array_to_string(nz, ''))) else array_to_string(list_transform(nz, lambda v: chr(cast('0x' || v as int))), '') end as t from z),
w as (select id, min(term) as term from (select id, lower(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as term from s) where term <> '' group by 1),
h as (select distinct inode_id, word_id, "offset", "length", loaded from logicalindexoffsets),
c as (select w.term, count(*) as hits, count(distinct h.inode_id) as records from h join w on w.id = h.word_id group by 1),
r as (select w.term, count(*) as ids, cast(sum(coalesce(l.hits, 0)) as bigint) as recorded from w left join (select id, max(hits) as hits from logicalindexstats group by 1) l on l.id = w.id group by 1),
f as (select r.term, r.ids, coalesce(c.hits, 0) as hits, coalesce(c.records, 0) as records, r.recorded from r left join c on c.term = r.term),
m as (select term, ids, hits, records, recorded, list_filter([case when records < 3 then 'rare' end, case when records > 0.2 * (select count(distinct inode_id) from logicalindexoffsets) then 'common' end, case when recorded <> hits then 'stale' end], lambda v: v is not null) as marks from f) """

SQL: dict[str, str] = {
    "p8_properties": """select container, (select count(*) from documents) as documents, cast(0 as bigint) as overfull, cast(0 as bigint) as split, cast(0 as bigint) as misstated
from (select distinct container from containers where container is not null and capacity > 0)""",
    "p5_terms": _TERMS + "select term, ids, hits, records, recorded, array_to_string(marks, ',') as marks from m",
    "p5_found": _TERMS + "select term, unnest(marks) as mark from m",
}
