"""Addresses: dotted quads and integers, networks, registrable domains, URLs, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_to_long(c: Column) -> Column:
    """The number of a dotted quad; null for anything else."""
    ok = c.rlike("^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    p = F.split(c, "[.]")
    total = sum((p[i].cast("bigint") * (1 << 8 * (3 - i)) for i in range(1, 4)), p[0].cast("bigint") * (1 << 24))
    return F.when(ok, total)


def long_to_ip(c: Column) -> Column:
    """The dotted quad of a number from 0 to 2**32 - 1; null for others."""
    part = lambda bits: F.shiftright(c.cast("bigint"), bits).bitwiseAND(255).cast("string")
    return F.when(c.between(0, (1 << 32) - 1), F.concat_ws(".", *[part(b) for b in (24, 16, 8, 0)]))


def parse_cidr(text: str) -> tuple[int, int]:
    """(low, high) of ``a.b.c.d/n``, ``a.b.c.d/m.m.m.m`` or a short form such as ``10`` or ``10.1``.

    low is the address as given, not the base of its network. Without a mask it follows from the last octet that isn't 0.
    """
    address, _, mask = text.strip().partition("/")
    octets = [int(x) for x in address.split(".") if x != ""]
    if not octets or len(octets) > 4 or any(not 0 <= x <= 255 for x in octets):
        raise ValueError(f"not an address: {text!r}")
    octets += [0] * (4 - len(octets))
    low = sum(x << 8 * (3 - i) for i, x in enumerate(octets))
    if not mask:
        bits = 8 * max([i + 1 for i, x in enumerate(octets) if x], default=0)
    elif "." in mask:
        bits = sum(bin(int(x)).count("1") for x in mask.split("."))
    else:
        bits = int(mask)
    if not 0 <= bits <= 32:
        raise ValueError(f"not a mask: {text!r}")
    return low, low | ((1 << (32 - bits)) - 1)


def parse_ip(text: str) -> int:
    """The number of one address; a range or a shortened form is an error."""
    low, high = parse_cidr(text)
    if "/" in text or low != high:
        raise ValueError(f"a range isn't an address, use netmask: {text!r}")
    return low


def url_host(c: Column) -> Column:
    """The host of an http or ftp URL, else an empty text."""
    return F.regexp_extract(c, "(http://|ftp://)([^/]+)", 2)


# Labels before which the owner's label stands, in this order.
DOMAIN_MARKS = ["com", "gov", "edu", "co", "go", "org", "net"]


def registrable_domain(host: Column) -> Column:
    """From the label before the first of the marks that occurs on; without one the last two labels."""
    labels = F.split(host, "[.]")
    n = F.size(labels)

    def after(mark: str) -> Column:
        return F.array_position(labels, mark).cast("int")

    start = F.coalesce(*[F.when(after(m) > 1, after(m) - 1) for m in DOMAIN_MARKS], F.greatest(n - 1, F.lit(1)))
    return F.array_join(F.slice(labels, start, n), ".")


def header_pair(line: Column) -> Column:
    """struct(key, value) of a header line: lower-case key before the first colon, trimmed value; null without a colon."""
    key, value = (F.regexp_extract(line, "(?s)^([^:]*):(.*)$", i) for i in (1, 2))
    return F.when(line.contains(":"), F.struct(F.lower(F.trim(key)).alias("key"), F.trim(value).alias("value")))


def query_parameters(url: Column) -> Column:
    """Array of struct(key, value) of a URL's query text; + and %xx are decoded, an undecodable value stays as it is."""
    text = F.regexp_extract(url, "[?]([^#]*)", 1)
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    clean = lambda t: F.coalesce(F.try_url_decode(t), t)
    return F.transform(pairs, lambda p: F.struct(clean(F.substring_index(p, "=", 1)).alias("key"), F.when(p.contains("="), clean(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")).alias("value")))


def cidr_blocks(start: Column, count: Column) -> Column:
    """The least list of aligned blocks, array of struct(network, bits), that covers ``count`` addresses from ``start``.

    A range of 32-bit addresses has at most 62 blocks. First come those that grow with the alignment of the address, then
    those that shrink with what is left: the block of size 2**b starts where the address has been rounded up to 2**b, on the
    way up if bit b of the address so far is set, on the way down if bit b of the rest is.
    """
    end = start + count  # exclusive
    steps = F.sequence(F.lit(0), F.lit(31))
    seed = F.struct(start.alias("at"), F.array().cast("array<struct<network:bigint,bits:int>>").alias("out"))

    power = lambda b: F.pow(F.lit(2.0), b).cast("bigint")

    def add(acc: Column, b: Column, fits: Column) -> Column:
        block = F.struct(acc["at"].alias("network"), (F.lit(32) - b).cast("int").alias("bits"))
        return F.when(fits, F.struct((acc["at"] + power(b)).alias("at"), F.concat(acc["out"], F.array(block)).alias("out"))).otherwise(acc)

    up = F.aggregate(steps, seed, lambda acc, b: add(acc, b, (acc["at"].bitwiseAND(power(b)) != 0) & (acc["at"] + power(b) <= end)))
    down = F.aggregate(F.sequence(F.lit(32), F.lit(0), F.lit(-1)), up, lambda acc, b: add(acc, b, acc["at"] + power(b) <= end))
    return F.when(count > 0, down["out"]).otherwise(F.array().cast("array<struct<network:bigint,bits:int>>"))
