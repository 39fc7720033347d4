"""Joins that aren't plain: longest prefix, as-of, containment, pairing, graph steps, enrichment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe import columns as C
from caseframe.functions import net
from caseframe.operators.running import running
from caseframe.session import Stages


def longest_prefix(addresses: DataFrame, ip: str, routes: DataFrame) -> DataFrame:
    """(ip, whois_id) of each distinct address by its longest route; addresses without a route have none.

    routes: network, netmask, whois_id; of repeated routes the smallest whois_id holds. Each address is tried with the masks
    that occur, so the range join is an equi-join. A mask is one of the 33 runs of leading ones; routes with any other number
    as mask have no prefix and match nothing.
    """
    valid = [(0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF for bits in range(33)]
    routes = routes.filter(F.col("netmask").isin(valid))
    masks = [r[0] for r in routes.select("netmask").distinct().orderBy("netmask").collect()]
    one = routes.filter(F.col("whois_id").isNotNull()).groupBy("network", "netmask").agg(F.min("whois_id").alias("whois_id"))
    ips = addresses.select(F.col(ip).cast("long").alias("ip")).filter("ip is not null").distinct()
    if not masks:
        return ips.select("ip", F.lit(None).cast("int").alias("whois_id")).limit(0)
    keys = ips.select("ip", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("netmask")).withColumn("network", F.col("ip").bitwiseAND(F.col("netmask")))
    return keys.join(one, ["network", "netmask"]).groupBy("ip").agg(F.max_by("whois_id", "netmask").alias("whois_id"))


def first_reaching(points: DataFrame, key: str, position: str, spans: DataFrame, end: str, value: str, width: int = 4096) -> DataFrame:
    """For each (key, position) the ``value`` of the first span of the key whose end reaches the position.

    Spans are looked up by blocks of ``width`` positions: a span's end lies in one block, and a point finds it in its own
    block or else takes the first end of the next block that has one, which is carried back over the blocks of its key.
    """
    block = lambda c: F.floor(c / width).cast("long")
    ends = spans.select(F.col(key), F.col(end).alias("_end"), F.col(value)).filter("_end is not null").withColumn("_block", block(F.col("_end")))
    marks = ends.groupBy(key, "_block").agg(F.min(F.struct("_end", value)).alias("_first"))
    asked = points.select(key, position).distinct().withColumn("_block", block(F.col(position)))
    blocks = asked.select(key, "_block").distinct().withColumn("_first", F.lit(None).cast(marks.schema["_first"].dataType))
    w = Window.partitionBy(key).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = marks.unionByName(blocks).groupBy(key, "_block").agg(F.min("_first").alias("_first")).withColumn("_later", F.last("_first", ignorenulls=True).over(w)).select(key, "_block", "_later")
    own = asked.join(ends, [key, "_block"], "left").groupBy(key, position, "_block").agg(F.min(F.when(F.col("_end") >= F.col(position), F.struct("_end", value))).alias("_own"))
    got = own.join(later, [key, "_block"], "left").withColumn("_got", F.coalesce("_own", "_later"))
    return points.join(got.select(key, position, F.col(f"_got.{value}").alias(value)), [key, position], "left")


def latest_before(events: DataFrame, key: str, order: str, kind: str, request: str, carried: list[str]) -> DataFrame:
    """Rows other than requests, with ``carried`` columns (prefixed ``request_``) of the latest request before them."""
    is_request = F.col(kind) == request
    # The latest request is the one of the greatest (order, ...) among earlier rows.
    held = F.struct(F.col(order).alias("_at"), *[F.col(c).alias(f"request_{c}") for c in carried])
    seen = running(events, key, order, {"_held": ("before", F.when(is_request, held))}).filter(~is_request)
    return seen.withColumns({f"request_{c}": F.col(f"_held.request_{c}") for c in carried}).drop("_held")


def containing(left: DataFrame, text: str, right: DataFrame, part: str, on: str) -> DataFrame:
    """Rows of both sides with equal ``on`` where ``text`` contains ``part``: an equi-join with a residual test."""
    return left.join(right, on).filter(F.col(text).contains(F.col(part)))


def pairs(streams: DataFrame, key: str = "inode_id") -> DataFrame:
    """(key, reverse): each stream with the first stream of the swapped endpoints."""
    ends = ["src_ip", "src_port", "dest_ip", "dest_port"]
    other = streams.groupBy(F.col("dest_ip").alias("src_ip"), F.col("dest_port").alias("src_port"), F.col("src_ip").alias("dest_ip"), F.col("src_port").alias("dest_port")).agg(F.min(key).alias("reverse"))
    return streams.join(other, ends, "left").select(key, "reverse")


def by_either_ports(packets: DataFrame, announced: DataFrame) -> DataFrame:
    """Packets with the session whose announced port pair they use in either direction; addresses don't count. Two equi-joins,
    since one on a disjunction would compare all with all."""
    forward = packets.join(announced, (packets["src_port"] == announced["a_port"]) & (packets["dest_port"] == announced["b_port"])).select(packets["id"], "session")
    backward = packets.join(announced, (packets["dest_port"] == announced["a_port"]) & (packets["src_port"] == announced["b_port"])).select(packets["id"], "session")
    return forward.unionByName(backward).distinct()


def graph_step(edges: DataFrame, names: DataFrame, outward: bool = True) -> DataFrame:
    """Distinct (name, next) one step along edges (name, pname, link): to parents, or from parents to children."""
    a, b = ("name", "pname") if outward else ("pname", "name")
    step = edges.select(F.col(a).alias("name"), F.col(b).alias("next"))
    return names.select("name").distinct().join(step, "name").distinct()


def graph_reach(edges: DataFrame, names: DataFrame, outward: bool = True) -> DataFrame:
    """Distinct (name, next) by any number of steps along edges (name, pname), circles included; each round only goes on from
    pairs that are new, and writes them once."""
    stages = Stages(edges.sparkSession, "reach")
    a, b = ("name", "pname") if outward else ("pname", "name")
    step = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).filter("_from is not null and _to is not null").distinct()
    n = F.count(F.lit(1))
    new = stages.write(names.select("name").distinct().join(step, F.col("name") == F.col("_from")).select("name", F.col("_to").alias("next")).distinct(), n=n)
    while stages.seen["n"]:
        further = new.join(step, F.col("next") == F.col("_from")).select("name", F.col("_to").alias("next")).distinct()
        new = stages.write(further.join(stages.read(), ["name", "next"], "left_anti"), n=n)
    return stages.read()


@dataclass(frozen=True)
class GeoIPType(C.IPType):
    """An address that can be tested and shown with what is known of it. ``cache``: ip and an id per dimension; ``dims``:
    dimension to (id, name)."""

    cache: DataFrame | None = field(default=None, hash=False, compare=False)
    dims: dict[str, DataFrame] = field(default_factory=dict, hash=False, compare=False)


def _known(c: GeoIPType, dimension: str, test: Column) -> Column:
    ids = c.dims[dimension].filter(test).select(F.col("id").alias(dimension))
    return C.exists(c.cache.join(ids, dimension, "left_semi"), "ip", c.expr)


# Operators on addresses and the dimension that each looks at.
for _name, _dim in {"whois_country": "country", "maxmind_country": "country", "maxmind_city": "city", "maxmind_isp": "isp", "maxmind_org": "org"}.items():
    C.operator(GeoIPType, _name)(lambda c, a, d=_dim: _known(c, d, F.lower("name") == a.lower()))
for _name, _dim in {"maxmind_isp_like": "isp", "maxmind_org_like": "org"}.items():
    C.operator(GeoIPType, _name)(lambda c, a, d=_dim: _known(c, d, F.lower("name").contains(a.lower())))


def enriched(df: DataFrame, ip: str, cache: DataFrame, dims: dict[str, DataFrame], missing: str = "Unknown") -> DataFrame:
    """Adds ``<ip>_<dimension>`` names of an address column; unknown ones are ``missing``."""
    out = df.join(cache.withColumnRenamed("ip", ip), ip, "left")
    for d, table in dims.items():
        named = table.select(F.col("id").alias(d), F.col("name").alias(f"{ip}_{d}"))
        out = out.join(named, d, "left").withColumn(f"{ip}_{d}", F.coalesce(f"{ip}_{d}", F.lit(missing))).drop(d)
    return out


def routes_of(ranges: DataFrame, start: str, count: str, key: str) -> DataFrame:
    """(network, netmask, whois_id) of address ranges: what :func:`longest_prefix` looks up."""
    blocks = ranges.select(F.col(key).alias("whois_id"), F.explode(net.cidr_blocks(F.col(start), F.col(count))).alias("b"))
    mask = F.lit(0xFFFFFFFF) - (F.pow(F.lit(2.0), F.lit(32) - F.col("b.bits")).cast("long") - 1)
    return blocks.select(F.col("b.network").alias("network"), mask.alias("netmask"), "whois_id")
