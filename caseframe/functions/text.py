"""Text, paths, globs, sizes and sets; native expressions, or plain Python where an argument is compiled once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a path glob: ``*`` and ``?`` don't cross ``/``; ``[..]`` is a class."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def glob_like(pattern: str) -> str:
    """A LIKE pattern of a plain glob: ``*`` is ``%``, ``?`` is ``_``; LIKE's own signs are escaped."""
    return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(ch, ch) for ch in pattern)


def normal_path(c: Column) -> Column:
    """One leading slash, none doubled, none at the end."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(c, "/+", "/"), "^/|/$", ""))


def path_parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def join_path(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def table_name(c: Column) -> Column:
    """Only letters, digits and underscores."""
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "_")


def printable(c: Column) -> Column:
    return F.regexp_replace(c, "[^\\x20-\\x7e]", "")


def label(c: Column, width: int = 20) -> Column:
    return F.left(printable(c), F.lit(width))


def size_value(c: Column) -> Column:
    """A number with hexadecimal (0x) or octal (0) prefix, and suffix s (512), k, m or g; null for anything else."""
    t = F.lower(F.trim(c))
    form = "^(0x[0-9a-f]+|0[0-7]+|[0-9]+)([skmg]?)$"
    number, suffix = F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 2)
    value = F.when(number.startswith("0x"), F.conv(F.substring(number, 3, 32), 16, 10)).when(number.rlike("^0[0-7]+$"), F.conv(number, 8, 10)).otherwise(number).try_cast("bigint")
    factor = F.when(suffix == "s", 512).when(suffix == "k", 1024).when(suffix == "m", 1024**2).when(suffix == "g", 1024**3).otherwise(1).cast("bigint")
    return F.when(t.rlike(form), value * factor)


def preview(text: Column, offset: Column, length: Column, before: int = 20, after: int = 50) -> Column:
    """Characters before a hit, the hit, and characters after it; offset counts from 0."""
    start = F.greatest(offset - before, F.lit(0))
    return F.substring(text, (start + 1).cast("int"), (offset - start + length + after).cast("int"))


def set_add(items: Column, item: Column) -> Column:
    return F.array_union(F.coalesce(items, F.array().cast("array<string>")), F.array(item))


def set_remove(items: Column, item: str) -> Column:
    return F.array_remove(items, item)


def record_field(record: Column, name: str) -> Column:
    """The values of one field of a ``name: value`` record, lines that continue one unfolded, joined by blanks."""
    unfolded = F.regexp_replace(record, "\n[ \t+]+", " ")
    found = F.regexp_extract_all(unfolded, F.lit(f"(?m)^{re.escape(name)}:[ \t]*(.*)$"), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.trim(x)), " ")


def first_record_field(record: Column, name: str) -> Column:
    unfolded = F.regexp_replace(record, "\n[ \t+]+", " ")
    return F.trim(F.regexp_extract(unfolded, f"(?m)^{re.escape(name)}:[ \t]*(.*)$", 1))


def quoted(c: Column) -> Column:
    """A text as a literal of a query: in single quotes, with quotes and backslashes escaped."""
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def hex_dump(c: Column, width: int = 16) -> Column:
    """Rows (offset, hex, shown) of ``width`` bytes each of binary content; ``shown`` has a point for what can't be printed."""
    rows = F.floor((F.octet_length(c) + (width - 1)) / width).cast("int")

    def row(i: Column) -> Column:
        part = F.substring(c, i * width + 1, F.lit(width))
        return F.struct((i * width).cast("long").alias("offset"), F.hex(part).alias("hex"), F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".").alias("shown"))

    return F.transform(F.when(rows > 0, F.sequence(F.lit(0), rows - 1)).otherwise(F.array().cast("array<int>")), row)
