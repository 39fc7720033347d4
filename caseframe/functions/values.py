"""Values in free notation as typed columns; native expressions only, null where a text states no value of the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that only say that nothing is known.
UNKNOWN = ["", "-", "--", "---", "—", "–", "?", "??", "~", "*", "****", "n/a", "na", "n.a.", "#n/a", "nan", "nil", "none", "(none)", "null", "(null)", "<null>", "\\n", "unknown", "(unknown)", "<unknown>",
           "undefined", "unset?", "<unset>", "(unset)", "not set", "(not set)", "<not set>", "not available", "not known", "empty", "(empty)", "[empty]", "<empty>", "tbd", "tba", "#ref!", "#div/0!", "#value!", "err"]
# Words for a truth value.
TRUE = ["true", "t", "yes", "y", "on", "1", "set", "enabled"]
FALSE = ["false", "f", "no", "n", "off", "0", "unset", "disabled"]
# Name spaces that metadata tools put before a property.
PREFIXES = ["exif", "ole", "dc", "meta", "pdf", "xmp", "id3", "iptc"]
# Units by factor, of whole numbers and of fractions.
WHOLE_UNITS = {"b": 1, "byte": 1, "bytes": 1, "sector": 1, "sectors": 1, "block": 1, "blocks": 1, "px": 1, "pixel": 1, "pixels": 1, "p": 1, "p.": 1, "pp": 1, "pp.": 1, "page": 1, "pages": 1, "word": 1, "words": 1,
               "kbps": 1, "kbit/s": 1, "kb/s": 1, "kb": 1000, "kib": 1024, "mb": 1000000, "mib": 1048576, "gb": 1000000000, "gib": 1073741824, "tb": 1000000000000, "tib": 1099511627776}
REAL_UNITS = {"%": 1.0, "percent": 1.0, "s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "ms": 0.001, "min": 60.0, "minutes": 60.0, "h": 3600.0, "dpi": 1.0, "ppi": 1.0}

_SPACE = "\\s\\x{0}\\x{A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}"


def cleaned(c: Column) -> Column:
    """Without white space, no-break spaces and NUL at either end."""
    return F.regexp_replace(c, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def property_name(c: Column) -> Column:
    """A property, however it is written, in lower case with single underscores: name space prefix, brackets, a trailing
    colon, separators and camel case are undone."""
    bare = F.regexp_replace(cleaned(c), f"^(?i)(?:{'|'.join(PREFIXES)})[:/.](?=[A-Za-z])", "")
    parted = F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(parted, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def text_value(c: Column) -> Column:
    return _let(cleaned(c), lambda v: F.when(~F.lower(v).isin(UNKNOWN), v))


def _factor(unit: Column, units: dict) -> Column:
    out = F.when(unit == "", F.lit(next(iter(units.values()))))
    for f in sorted(set(units.values())):
        out = out.when(unit.isin([u for u, x in units.items() if x == f]), F.lit(f))
    return out


def _let(c: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(c), body)[0]


def _split(c: Column, pattern: str, groups: int) -> Column:
    """The groups of an anchored pattern as an array, absent ones empty; null where the pattern doesn't match."""
    return F.when(c.rlike(pattern), F.split(F.regexp_replace(c, pattern, "\u0001".join(f"${g}" for g in range(1, groups + 1))), "\u0001"))


def whole_value(c: Column) -> Column:
    """A whole number: plain, signed, grouped by comma, apostrophe or space, with a zero fraction, hexadecimal, with unit."""
    grouped = f"[0-9]{{1,3}}(?:[,'’{_SPACE}][0-9]{{3}})+"
    pattern = f"^([+-]?)({grouped}|[0-9]+)(?:\\.0+)?[{_SPACE}]*([A-Za-z][A-Za-z/]*\\.?)?$"

    def plain(v: Column) -> Column:
        number = F.regexp_replace(v[1], "[^0-9]", "").try_cast("bigint")
        return F.try_multiply(number, _factor(F.lower(v[2]), WHOLE_UNITS).cast("bigint")) * F.when(v[0] == "-", -1).otherwise(1)

    def either(v: Column) -> Column:
        return F.when(v.rlike("^\\+?0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.regexp_extract(v, "0[xX]([0-9A-Fa-f]+)", 1), 16, 10).try_cast("bigint")).otherwise(_let(_split(v, pattern, 3), plain))

    return _let(cleaned(c), either)


def real_value(c: Column) -> Column:
    """A number with a point or comma, sign, exponent, grouping, unit, or as a clock (mm:ss, hh:mm:ss) in seconds."""
    pattern = f"^([+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+\\.[0-9]+|[0-9]{{1,3}}(?:\\.[0-9]{{3}})+,[0-9]+|[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]{{1,3}})?)[{_SPACE}]*([A-Za-z%]*)$"

    def number(v: Column) -> Column:
        both = v[0].contains(",") & v[0].contains(".")
        comma_last = F.instr(v[0], ",") > F.instr(v[0], ".")
        point = F.when(both & ~comma_last, F.regexp_replace(v[0], ",", "")).when(both, F.regexp_replace(F.regexp_replace(v[0], "\\.", ""), ",", ".")).otherwise(F.regexp_replace(v[0], ",", "."))
        return point.try_cast("double") * _factor(F.lower(v[1]), REAL_UNITS)

    def clock(v: Column) -> Column:
        return F.coalesce(v[0].try_cast("double"), F.lit(0.0)) * 3600 + v[1].try_cast("double") * 60 + v[2].try_cast("double")

    return _let(cleaned(c), lambda v: F.coalesce(_let(_split(v, pattern, 2), number), _let(_split(v, "^(?:([0-9]{1,3}):)?([0-9]{1,2}):([0-9]{2}(?:\\.[0-9]+)?)$", 3), clock)))


def truth_value(c: Column) -> Column:
    return _let(F.lower(cleaned(c)), lambda v: F.when(v.isin(TRUE), True).when(v.isin(FALSE), False))


def _time_forms() -> list[tuple[str, tuple]]:
    """Patterns, each with its groups of year, month, day, hour, minute, second, zone."""
    number = "([0-9]{1,2})"
    clock = "(?:[T ]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:[.,][0-9]+)?)?"
    zone = " ?(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})?"
    month = "(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?)"
    return [
        (f"^([0-9]{{4}})[-/.:]{number}[-/.:]{number}{clock}{zone}$", (1, 2, 3, 4, 5, 6, 7)),
        ("^(?:D:)?([0-9]{4})([0-9]{2})([0-9]{2})(?:T?([0-9]{2})([0-9]{2})([0-9]{2}))?([+-][0-9]{2}'?[0-9]{2}|Z)?'?$", (1, 2, 3, 4, 5, 6, 7)),
        (f"^{number}[.]{number}[.]([0-9]{{4}}){clock}{zone}$", (3, 2, 1, 4, 5, 6, 7)),
        (f"^{number}/{number}/([0-9]{{4}}){clock}{zone}$", (3, 2, 1, 4, 5, 6, 7)),
        (f"^(?:[A-Za-z]{{3,9}},? )?{number}[ -]{month}[ -]([0-9]{{4}}){clock}{zone}$", (3, 2, 1, 4, 5, 6, 7)),
        (f"^\\[?{number}/{month}/([0-9]{{4}}):([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}}){zone}\\]?$", (3, 2, 1, 4, 5, 6, 7)),
        (f"^(?:[A-Za-z]{{3,9}},? )?{month} +{number} ([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}}) ([0-9]{{4}})$", (6, 1, 2, 3, 4, 5, None)),
        (f"^(?:[A-Za-z]{{3,9}},? )?{month} +{number},? ([0-9]{{4}}){clock}{zone}$", (3, 1, 2, 4, 5, 6, 7)),
    ]


def time_value(c: Column) -> Column:
    """A timestamp in UTC (the session's zone): ISO and EXIF forms, PDF dates, day.month.year, day Month year, web server and
    ctime forms, and epochs of seconds, milliseconds or microseconds. Impossible dates are null."""

    def two(x: Column) -> Column:
        return F.lpad(x, 2, "0")

    def written(p: Column) -> Column:
        named = F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(p[2], 1, 3))) + 2) / 3).cast("int").cast("string"), 2, "0")
        month = F.when(p[2].rlike("^[0-9]"), two(p[2])).otherwise(named)
        local = F.try_to_timestamp(F.concat(p[1], F.lit("-"), month, F.lit("-"), two(p[3]), F.lit(" "), two(p[4]), F.lit(":"), two(p[5]), F.lit(":"), two(p[6])), F.lit("yyyy-MM-dd HH:mm:ss"))
        digits = F.regexp_replace(p[7], "[^0-9]", "")
        minutes = F.when(F.length(digits) == 4, F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")).otherwise(F.lit(0))
        ahead = F.when(p[7].startswith("-"), -minutes).otherwise(minutes)
        return F.when((F.size(p) == 8) & (p[1] >= "0001"), F.timestamp_micros(F.unix_micros(local) - ahead.cast("long") * 60_000_000))

    def since(v: Column) -> Column:
        scale = F.when(F.length(v) <= 10, 1_000_000).when(F.length(v) <= 13, 1000).otherwise(1)
        return F.when(v.rlike("^(?:[0-9]{9,10}|[0-9]{12,13}|[0-9]{15,16})$"), F.timestamp_micros(v.try_cast("bigint") * scale))

    v = cleaned(c)
    parted = v
    for pattern, groups in _time_forms():
        parted = F.regexp_replace(parted, pattern, "".join(f"\u0001${g}" if g else "\u0001" for g in groups))
    return F.coalesce(_let(F.split(parted, "\u0001"), written), _let(v, since))
