"""Timestamps of log lines as epoch seconds, independent of the session's time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from arclog.functions import text as t

ZONE = r"(Z|[+-]\d\d:?\d\d)$"
SYSLOG = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s"


def iso_epoch(value: Column) -> Column:
    """ISO 8601 text as epoch seconds; without an offset it is UTC; null where it is none."""
    s = F.trim(value)
    full = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z"))).when(s.rlike(ZONE), s).otherwise(F.concat(s, F.lit("Z")))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.unix_seconds(full.try_cast("timestamp")))


def numeric_epoch(value: Column) -> Column:
    """A number as epoch seconds if it lies from 1e9 to 9e9, so that milliseconds don't pass."""
    number = value.try_cast("double")
    return F.when(number.between(1e9, 9e9), F.floor(number).cast("long"))


def syslog_epoch(line: Column, year: int) -> Column:
    """The time at the head of a syslog line, which has no year of its own."""
    at = lambda i: F.regexp_extract(line, SYSLOG, i)
    month = F.array_position(F.array(*[F.lit(m) for m in t.MONTHS]), at(1))
    stamp = F.concat(F.lit(f"{year:04d}-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(at(2), 2, "0"), F.lit("T"), at(3), F.lit(":"), at(4), F.lit(":"), at(5), F.lit("Z"))
    return F.when(line.rlike(SYSLOG) & (month > 0), F.unix_seconds(stamp.try_cast("timestamp")))


def json_epoch(line: Column) -> Column:
    """The first alias of a JSON line's timestamp that is a time."""
    each = []
    for key in t.ALIASES["timestamp"]:
        value = t.json_value(line, key)
        each += [iso_epoch(value), numeric_epoch(value)]
    return F.when(t.is_json_object(line), F.coalesce(*each))


def line_epoch(line: Column, fmt: Column, year: int) -> Column:
    """A line's time by the archive's format; plain text may be either of the others."""
    as_json, as_syslog = json_epoch(line), syslog_epoch(line, year)
    return F.when(fmt == "json", as_json).when(fmt == "syslog", as_syslog).otherwise(F.coalesce(as_json, as_syslog))


def date_bound(value: str | int | None, end: bool = False) -> int | None:
    """A bound given as ISO date or time (UTC) or epoch; a bare date as end means its last second."""
    if value is None or isinstance(value, int):
        return value
    text = value.strip()
    stamp = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    if end and "T" not in text and " " not in text:
        stamp += timedelta(hours=23, minutes=59, seconds=59)
    return int((stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)).timestamp())
