"""Typed columns: what each selects, sorts by, implies and can be tested with.

A column type binds a display name to a native expression. Its operators are functions registered by type and name, so that
other modules add operators to existing types; each returns a native Column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.filterlang import FilterError
from caseframe.functions import dates, net

_OPERATORS: dict[tuple[type, str], Callable] = {}
_ROW_OPERATORS: dict[tuple[type, str], Callable] = {}


def operator(kind: type, *names: str) -> Callable:
    """Registers ``f(column, argument) -> Column`` as operators of a column type and its subtypes."""

    def keep(f: Callable) -> Callable:
        for n in names:
            _OPERATORS[kind, n] = f
        return f

    return keep


def row_operator(kind: type, *names: str) -> Callable:
    """Registers ``f(column, argument) -> (value -> bool)``, the row-wise counterpart."""

    def keep(f: Callable) -> Callable:
        for n in names:
            _ROW_OPERATORS[kind, n] = f
        return f

    return keep


@dataclass(frozen=True)
class ColumnType:
    """name is shown; source is the column of ``table``; ``cases`` lists (operator, argument, should fail) for the tests."""

    name: str
    source: str | None = None
    table: str | None = None
    spark_type = T.StringType()
    pattern = r"\S+"

    @property
    def expr(self) -> Column:
        return F.col(f"`{self.source or self.name}`")

    def select(self) -> Column:
        return self.expr.alias(self.name)

    def order_by(self) -> Column:
        return self.expr

    def where(self) -> Column | None:
        """A condition that selecting the column implies."""
        return None

    def csv(self) -> Column:
        return self.expr.cast("string")

    def extended(self) -> list[Column]:
        """What an export with enrichment shows instead of the one column."""
        return [self.select()]

    def parsed(self, text: Column) -> Column:
        """The typed value of a piece of log text."""
        return text.try_cast(self.spark_type)

    @classmethod
    def operators(cls) -> list[str]:
        return sorted({n for k, n in _OPERATORS if issubclass(cls, k)})

    def _find(self, registry: dict, name: str) -> Callable:
        for k in type(self).__mro__:
            if (k, name) in registry:
                return registry[k, name]
        raise FilterError(f"{type(self).__name__} {self.name!r} has no operator {name!r}; it has {', '.join(self.operators())}")

    def test(self, name: str, argument: str) -> Column:
        return self._find(_OPERATORS, name)(self, argument)

    def row_test(self, name: str, argument: str) -> Callable:
        return self._find(_ROW_OPERATORS, name)(self, argument)


@dataclass(frozen=True)
class IntegerType(ColumnType):
    spark_type = T.IntegerType()
    pattern = r"[-+]?\d+"

    def number(self, argument: str) -> int:
        try:
            return int(argument, 0)
        except ValueError as e:
            raise FilterError(f"{self.name!r} is compared with a number, not {argument!r}") from e


@dataclass(frozen=True)
class BigIntegerType(IntegerType):
    spark_type = T.LongType()


@dataclass(frozen=True)
class ShortIntegerType(IntegerType):
    pass


@dataclass(frozen=True)
class PacketType(BigIntegerType):
    pass


@dataclass(frozen=True)
class FloatType(ColumnType):
    spark_type = T.DoubleType()
    pattern = r"[-+]?[\d.]+"

    def number(self, argument: str) -> float:
        try:
            return float(argument)
        except ValueError as e:
            raise FilterError(f"{self.name!r} is compared with a number, not {argument!r}") from e


@dataclass(frozen=True)
class StringType(ColumnType):
    pass


@dataclass(frozen=True)
class LongStringType(StringType):
    pass


@dataclass(frozen=True)
class BlobType(StringType):
    spark_type = T.BinaryType()

    @property
    def expr(self) -> Column:
        return F.col(f"`{self.source or self.name}`").cast("string")


@dataclass(frozen=True)
class StateType(ColumnType):
    """A text of a closed set; ``states`` maps names (any case) to stored values."""

    states: dict[str, str] = field(default_factory=dict, hash=False)

    def value(self, state: str) -> str:
        for n, v in self.states.items():
            if n.lower() == state.lower():
                return v
        raise FilterError(f"{self.name!r} has no state {state!r}; it has {', '.join(self.states)}")


@dataclass(frozen=True)
class DeletedType(StateType):
    states: dict[str, str] = field(default_factory=lambda: {"deleted": "deleted", "allocated": "alloc"}, hash=False)


@dataclass(frozen=True)
class BinaryType(StateType):
    states: dict[str, str] = field(default_factory=lambda: {"true": "true", "set": "true", "false": "false", "unset": "false"}, hash=False)

    @property
    def expr(self) -> Column:
        return F.col(f"`{self.source or self.name}`").cast("string")


@dataclass(frozen=True)
class SetType(ColumnType):
    spark_type = T.ArrayType(T.StringType())


@dataclass(frozen=True)
class TimestampType(ColumnType):
    spark_type = T.TimestampType()
    pattern = r"\S+ \S+"
    form: str = "yyyy-MM-dd HH:mm:ss"

    def moment(self, argument: str) -> str:
        try:
            return dates.guess_date(argument).strftime("%Y-%m-%d %H:%M:%S")
        except ValueError as e:
            raise FilterError(f"{self.name!r} is compared with a date, not {argument!r}") from e

    def parsed(self, text: Column) -> Column:
        return F.try_to_timestamp(text, F.lit(self.form))


@dataclass(frozen=True)
class EpochTimestampType(TimestampType):
    pattern = r"\d+"

    def parsed(self, text: Column) -> Column:
        return F.timestamp_seconds(text.try_cast("bigint"))


@dataclass(frozen=True)
class DateType(TimestampType):
    spark_type = T.DateType()


@dataclass(frozen=True)
class IPType(ColumnType):
    """An address stored as a number, shown as a dotted quad."""

    spark_type = T.LongType()
    pattern = r"\d+\.\d+\.\d+\.\d+"

    def select(self) -> Column:
        return net.long_to_ip(self.expr).alias(self.name)

    def csv(self) -> Column:
        return net.long_to_ip(self.expr)

    def parsed(self, text: Column) -> Column:
        return net.ip_to_long(text)

    def number(self, argument: str) -> int:
        try:
            return net.parse_ip(argument)
        except ValueError as e:
            raise FilterError(str(e)) from e


@dataclass(frozen=True)
class InodeIDType(BigIntegerType):
    """The object key. ``inodes`` (inode_id, inode), ``annotations`` (inode_id, note) and ``types`` (inode_id, type) serve its
    operators."""

    inodes: DataFrame | None = field(default=None, hash=False, compare=False)
    annotations: DataFrame | None = field(default=None, hash=False, compare=False)
    types: DataFrame | None = field(default=None, hash=False, compare=False)


@dataclass(frozen=True)
class FilenameType(StringType):
    """path and name of a file; tests are semi-joins of inode_id against ``files`` (inode_id, path, name)."""

    files: DataFrame | None = field(default=None, hash=False, compare=False)

    @property
    def expr(self) -> Column:
        return F.concat(F.col("path"), F.col("name"))


@dataclass(frozen=True)
class InodeInfoType(StringType):
    """A field of the inode table; tests are semi-joins of inode_id."""

    inodes: DataFrame | None = field(default=None, hash=False, compare=False)


@dataclass(frozen=True)
class PCAPTimeType(TimestampType):
    """A packet id shown as its time; tests become tests of the packet id against ``packets`` (id, ts)."""

    packets: DataFrame | None = field(default=None, hash=False, compare=False)


@dataclass(frozen=True)
class CounterType(BigIntegerType):
    @property
    def expr(self) -> Column:
        return F.count(F.lit(1))


@dataclass(frozen=True)
class HashType(StringType):
    """A binary digest shown in upper-case hexadecimal."""

    @property
    def expr(self) -> Column:
        return F.upper(F.hex(F.col(f"`{self.source or self.name}`")))


@dataclass(frozen=True)
class OffsetType(BigIntegerType):
    """Offset and length of a hit shown as ``offset,length``."""

    def select(self) -> Column:
        return F.concat_ws(",", self.expr, F.col("length")).alias(self.name)


@dataclass(frozen=True)
class WordType(StringType):
    """A dictionary word; ``=`` is a keyword hit in any letter case."""


@dataclass(frozen=True)
class ClassType(StringType):
    """A dictionary class; showing it hides private classes, which start with an underscore."""

    def where(self) -> Column:
        return F.substring(self.expr, 1, 1) != "_"


@dataclass(frozen=True)
class PadType(ColumnType):
    """Text that a log reader consumes and drops."""

    def parsed(self, text: Column) -> Column:
        return F.lit(None).cast("string")


# ---- operators ------------------------------------------------------------------------------------------------------


def _compare(name: str) -> Callable:
    return {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[name]


def _comparisons(kind: type, names: list[str], expr: Callable, value: Callable, row: Callable | None = None) -> None:
    for n in names:
        f = _compare(n)
        operator(kind, n)(lambda c, a, f=f: f(expr(c), value(c, a)))
        row_operator(kind, n)(lambda c, a, f=f: (lambda v, w=(row or value)(c, a): f(v, w)))


_ALL = ["=", "!=", "<", "<=", ">", ">="]
_comparisons(ColumnType, ["="], lambda c: c.expr, lambda c, a: a)
_comparisons(IntegerType, _ALL, lambda c: c.expr, lambda c, a: c.number(a))
_comparisons(FloatType, _ALL, lambda c: c.expr, lambda c, a: c.number(a))
_comparisons(IPType, _ALL, lambda c: c.expr, lambda c, a: c.number(a))
_comparisons(TimestampType, _ALL, lambda c: c.expr, lambda c, a: F.lit(c.moment(a)).cast("timestamp_ntz"), lambda c, a: dates.guess_date(a))


def _lower_compare(name: str) -> None:
    f = _compare(name)
    operator(StringType, name)(lambda c, a: f(F.lower(c.expr), a.lower()))
    row_operator(StringType, name)(lambda c, a: (lambda v: f(str(v).lower(), a.lower())))


_lower_compare("=")
_lower_compare("!=")


@operator(StringType, "contains")
def _contains(c: ColumnType, a: str) -> Column:
    return F.lower(c.expr).contains(a.lower())


@operator(StringType, "matches")
def _matches(c: ColumnType, a: str) -> Column:
    return c.expr.ilike(a)


@operator(StringType, "regex")
def _regex(c: ColumnType, a: str) -> Column:
    try:
        re.compile(a)
    except re.error as e:
        raise FilterError(f"not a regular expression: {a!r}") from e
    return c.expr.rlike("(?i)" + a)


row_operator(StringType, "contains")(lambda c, a: (lambda v: a.lower() in str(v).lower()))
row_operator(StringType, "matches")(lambda c, a: (lambda v, r=re.compile("".join({"%": ".*", "_": "."}.get(x, re.escape(x)) for x in a), re.I | re.S): r.fullmatch(str(v)) is not None))
row_operator(StringType, "regex")(lambda c, a: (lambda v, r=re.compile(a, re.I): r.search(str(v)) is not None))


@operator(StateType, "is")
def _is(c: StateType, a: str) -> Column:
    return c.expr == c.value(a)


row_operator(StateType, "is")(lambda c, a: (lambda v, w=c.value(a): str(v) == w))


@operator(TimestampType, "after")
def _after(c: TimestampType, a: str) -> Column:
    return c.expr > F.lit(c.moment(a)).cast("timestamp_ntz")


@operator(TimestampType, "before")
def _before(c: TimestampType, a: str) -> Column:
    return c.expr < F.lit(c.moment(a)).cast("timestamp_ntz")


row_operator(TimestampType, "after")(lambda c, a: (lambda v, w=dates.guess_date(a): v > w))
row_operator(TimestampType, "before")(lambda c, a: (lambda v, w=dates.guess_date(a): v < w))


@operator(IPType, "netmask", "matches")
def _netmask(c: IPType, a: str) -> Column:
    low, high = _cidr(a)
    return c.expr.between(low, high)


def _cidr(a: str) -> tuple[int, int]:
    try:
        return net.parse_cidr(a)
    except ValueError as e:
        raise FilterError(str(e)) from e


row_operator(IPType, "netmask", "matches")(lambda c, a: (lambda v, w=_cidr(a): w[0] <= v <= w[1]))


def exists(df: DataFrame, inner: str, outer: Column) -> Column:
    """``outer`` is among the column ``inner`` of ``df``: a semi-join, and composable with and/or."""
    return outer.isin(df.select(inner))


@operator(InodeIDType, "contains")
def _inode_contains(c: InodeIDType, a: str) -> Column:
    return exists(c.inodes.filter(F.lower("inode").contains(a.lower())), "inode_id", c.expr)


@operator(InodeIDType, "annotated")
def _annotated(c: InodeIDType, a: str) -> Column:
    return exists(c.annotations.filter(F.lower("note").contains(a.lower())), "inode_id", c.expr)


@operator(InodeIDType, "has_magic")
def _has_magic(c: InodeIDType, a: str) -> Column:
    return exists(c.types.filter(F.lower("type").contains(a.lower())), "inode_id", c.expr)


def _through(kind: type, name: str, table: Callable, text: Callable) -> None:
    """A string operator as a semi-join: applied to ``text`` of ``table``, then tested on inode_id."""
    inner = _OPERATORS[StringType, name]

    def apply(c: ColumnType, a: str) -> Column:
        rows = table(c).select("inode_id", text(c).alias("_text"))
        return exists(rows.filter(inner(StringType("_text"), a)), "inode_id", F.col("inode_id"))

    operator(kind, name)(apply)


for _n in ("=", "!=", "contains", "matches", "regex"):
    _through(FilenameType, _n, lambda c: c.files, lambda c: F.concat(F.col("path"), F.col("name")))
    _through(InodeInfoType, _n, lambda c: c.inodes, lambda c: F.col(c.source or c.name))


def _packet_bound(c: PCAPTimeType, a: str, op: str) -> Column:
    at = F.lit(c.moment(a)).cast("timestamp_ntz")
    rows = c.packets
    if op == "after":
        bound = rows.filter(F.col("ts") > at).agg(F.min("id").alias("b"))
        return c.expr >= bound.scalar()
    if op == "before":
        bound = rows.filter(F.col("ts") < at).agg(F.max("id").alias("b"))
        return c.expr <= bound.scalar()
    return exists(rows.filter(F.date_trunc("second", "ts") == at), "id", c.expr)


for _n in ("after", "before", "="):
    operator(PCAPTimeType, _n)(lambda c, a, op=_n: _packet_bound(c, a, op))


def registry() -> dict[str, list[str]]:
    """Operator names of every column type."""

    def subtypes(k: type) -> list[type]:
        return [k, *(x for s in k.__subclasses__() for x in subtypes(s))]

    return {k.__name__: k.operators() for k in subtypes(ColumnType)}
