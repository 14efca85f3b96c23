"""Retention policies from a YAML list of streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_STREAMS = 64


@dataclass(frozen=True)
class Stream:
    name: str
    pattern: str
    retention_days: int
    lock: bool


def _value(text: str) -> str:
    """A scalar without quotes or a comment behind it."""
    text = text.strip()
    if text[:1] in ("'", '"') and text.find(text[0], 1) > 0:
        return text[1 : text.index(text[0], 1)]
    return text.split(" #")[0].strip()


def parse(text: str) -> list[Stream]:
    """The streams of a policy: a list below ``streams:``; unknown keys are ignored."""
    entries: list[dict[str, str]] = []
    inside = False
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if not line[0].isspace() and not body.startswith("-"):
            inside = body.rstrip() == "streams:"
            continue
        if not inside:
            continue
        if body.startswith("-"):
            entries.append({})
            body = body[1:].strip()
        key, colon, value = body.partition(":")
        if colon and entries:
            entries[-1][key.strip()] = _value(value)
    streams = []
    for i, entry in enumerate(entries):
        name, pattern = entry.get("name", ""), entry.get("pattern", "")
        days = int(entry["retention_days"]) if entry.get("retention_days", "").isdigit() else 0
        if not name or not pattern.startswith("s3://") or days <= 0:
            raise ValueError(f"stream {i} needs a name, an s3:// pattern and positive retention_days")
        streams.append(Stream(name, pattern, days, entry.get("lock", "").lower() in ("true", "yes", "1")))
    if not 1 <= len(streams) <= MOST_STREAMS:
        raise ValueError(f"a policy has from 1 to {MOST_STREAMS} streams, not {len(streams)}")
    return streams


def list_prefix(pattern: str) -> tuple[str, str]:
    """(bucket, prefix) to list for a pattern: what stands before its first ``*``."""
    bucket, _, key = pattern.removeprefix("s3://").partition("/")
    return bucket, key.lstrip("/").split("*")[0]


def as_table(spark: SparkSession, streams: list[Stream]) -> DataFrame:
    """(name, pattern, retention_days, lock)"""
    rows = F.array(*[
        F.struct(F.lit(s.name).alias("name"), F.lit(s.pattern).alias("pattern"), F.lit(s.retention_days).cast("long").alias("retention_days"), F.lit(s.lock).alias("lock"))
        for s in streams
    ])
    return spark.range(1).select(F.inline(rows))
