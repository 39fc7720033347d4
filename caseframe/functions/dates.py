"""Dates in free form, default years, time zones, epochs and bins."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms that a typed date is tried in, in order. A leading day of the week says nothing more.
GUESSES = ["yyyyMMdd HH:mm:ss", "yyyyMMdd HH:mm", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy/MM/dd:HH:mm:ss", "dd MMM yyyy HH:mm:ss z"]
GUESSES += ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d yyyy HH:mm:ss", "MMM d yyyy"]  # further ones
_WEEKDAY = "^(?:[A-Za-z]{3}), "
_PYTHON = {"yyyy": "%Y", "MMM": "%b", "MM": "%m", "dd": "%d", "d": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "z": "%Z"}


def guess_date(text: str) -> datetime:
    """A typed date, by the first form that fits; seconds since 1970 are taken too. In UTC."""
    t = re.sub(_WEEKDAY, "", " ".join(text.split()))
    if re.fullmatch(r"[0-9]{9,10}", t):
        return datetime.fromtimestamp(int(t), timezone.utc).replace(tzinfo=None)
    for form in GUESSES:
        try:
            return datetime.strptime(t, re.sub("yyyy|MMM|MM|dd|d|HH|mm|ss|z", lambda m: _PYTHON[m.group()], form))
        except ValueError:
            continue
    raise ValueError(f"not a date: {text!r}")


def guess_column(c: Column) -> Column:
    """The same for a column; null where no form fits."""
    t = F.regexp_replace(F.trim(F.regexp_replace(c, "\\s+", " ")), _WEEKDAY, "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(form)) for form in GUESSES], F.when(t.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(t.try_cast("bigint"))))


def with_year(c: Column, form: str, year: int = 2007) -> Column:
    """A time written without a year, such as ``MMM d HH:mm:ss``, in the given year."""
    return F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.trim(F.regexp_replace(c, " +", " "))), F.lit(f"yyyy {form}"))


def convert_zone(c: Column, source: str, target: str) -> Column:
    """Wall time of one zone as wall time of another."""
    return F.from_utc_timestamp(F.to_utc_timestamp(c, source), target)


def from_filetime(c: Column) -> Column:
    """Ticks of 100 ns since 1601 as a timestamp."""
    return F.timestamp_micros(F.floor(c / 10).cast("bigint") - 11_644_473_600_000_000)


def bin_start(c: Column, seconds: int) -> Column:
    """Seconds since 1970 of the start of the bin that holds a timestamp."""
    return (F.floor(F.unix_timestamp(c) / seconds) * seconds).cast("bigint")
