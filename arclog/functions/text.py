"""Scalar functions on log lines: tokens, hashes, JSON fields, quoting, URLs, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format: delimiters of tokens as a pattern, keys of logical fields in the
# order in which they are tried, and the keys whose values the field filter holds.
TOKEN_SPLIT = r'[ ":\n\r\t,{}\[\]]+'
ALIASES = {
    "timestamp": ("timestamp", "time", "ts", "@timestamp"),
    "level": ("level", "severity"),
    "user": ("user", "user_id", "username"),
    "ip": ("ip", "ip_address"),
    "action": ("action",),
    "message": ("message", "msg"),
}
FIELD_KEYS = ("user", "user_id", "username", "ip", "ip_address", "action", "level", "severity")
EXPORT_COLUMNS = ("timestamp", "level", "user", "ip", "action", "message", "raw")

MASK = 4294967295


def tokens(text: Column) -> Column:
    """The tokens of a text in order: what stands between runs of delimiters."""
    return F.filter(F.split(text, TOKEN_SPLIT), lambda t: t != "")


def interior_tokens(query: str) -> list[str]:
    """Tokens that any line with ``query`` must have whole: a delimiter stands on both sides."""
    parts = re.split(TOKEN_SPLIT, query)
    return [t for t in parts[1:-1] if t]


def query_tokens(query: str) -> list[str]:
    """Tokens that the lossy search asks for; a query of delimiters alone asks for itself."""
    return [t for t in re.split(TOKEN_SPLIT, query) if t] or [query]


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    raw = text.cast("binary")
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))),
        lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(F.octet_length(raw) == 0, F.array().cast("array<bigint>")).otherwise(every)


def _fold(text: Column, start: int, step) -> Column:
    return F.aggregate(byte_values(text), F.lit(start).cast("long"), lambda h, c: step(h, c).bitwiseAND(F.lit(MASK)))


def djb2(text: Column) -> Column:
    return _fold(text, 5381, lambda h, c: h * 33 + c)


def fnv1a(text: Column) -> Column:
    return _fold(text, 2166136261, lambda h, c: h.bitwiseXOR(c) * 16777619)


def sdbm(text: Column) -> Column:
    return _fold(text, 0, lambda h, c: c + h * 65599)


def py_hashes(data: bytes) -> tuple[int, int, int]:
    """The three hashes of a constant, for predicates that are built on the driver."""
    a, b, c = 5381, 2166136261, 0
    for x in data:
        a, b, c = (a * 33 + x) & MASK, ((b ^ x) * 16777619) & MASK, (x + c * 65599) & MASK
    return a, b, c


def is_json_object(line: Column) -> Column:
    """Whether a line is a JSON object with nothing behind it."""
    return F.try_parse_json(line).isNotNull() & line.rlike(r"(?s)^\s*\{.*\}\s*$")


def is_json(line: Column) -> Column:
    """Whether a line is any JSON value, bare scalars included."""
    scalar = line.rlike(r'^\s*(-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|"([^"\\]|\\.)*"|\[.*\])\s*$')
    return is_json_object(line) | (F.try_parse_json(line).isNotNull() & scalar)


def looks_like_json(line: Column) -> Column:
    """The quick test: the line stands in braces."""
    return line.rlike(r"^\{.*\}[ \t\r]*$")


def is_syslog(line: Column) -> Column:
    return line.rlike(r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s")


# The months' names in syslog lines.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def looks_like_syslog(line: Column) -> Column:
    """The quick test: the line begins with a month."""
    return F.substring(line, 1, 3).isin(*MONTHS)


def json_value(line: Column, key: str) -> Column:
    return F.get_json_object(line, f"$['{key}']")


def first_field(line: Column, field: str) -> Column:
    """The value of the first alias of a logical field that is there, as text; else null."""
    return F.coalesce(*[json_value(line, key) for key in ALIASES[field]])


def field_values(line: Column) -> Column:
    """The values that the field filter holds for a line; none where it is no JSON object."""
    values = F.array_compact(F.array(*[json_value(line, key) for key in FIELD_KEYS]))
    return F.when(is_json_object(line), values).otherwise(F.array().cast("array<string>"))


def right_trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"[\r\n]+$", "")


def csv_quoted(text: Column) -> Column:
    """A CSV field, quoted where it has to be."""
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def s3_parts(url: Column) -> Column:
    """(bucket, key) of an s3 URL; null where it is none."""
    pattern = r"^s3://([^/]+)/+(.+)$"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("bucket"), F.regexp_extract(url, pattern, 2).alias("key")))


def glob_regex(glob: Column) -> Column:
    """A pattern in which ``*`` stands for anything but ``/``, as a regular expression."""
    escaped = F.regexp_replace(glob, r"([.\\+?\[\]\^\$\(\)\{\}\|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("$"))


def url_encoded(key: Column) -> Column:
    """An object's key as it stands in a URL: slashes stay, all but unreserved characters are
    escaped."""
    out = F.url_encode(key)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out
