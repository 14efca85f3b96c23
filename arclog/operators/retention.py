"""Retention: what is to be locked, kept or deleted, as a table of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclog.functions import text as t
from arclog.functions.times import iso_epoch

DAY = 86400


def _locked_days(now: int) -> Column:
    return F.floor((iso_epoch(F.col("lock_until")) - F.lit(now)) / DAY)


def lock_status(objects: DataFrame, now: int) -> DataFrame:
    """(bucket, key, status): LOCKED with mode and date, UNKNOWN_LOCK, or NOT LOCKED."""
    days = _locked_days(now)
    status = (
        F.when(F.coalesce(F.col("lock_mode"), F.lit("")) == "", "NOT LOCKED")
        .when(days.isNull(), "UNKNOWN_LOCK")
        .when(days > 0, F.concat(F.lit("LOCKED — "), F.col("lock_mode"), F.lit(" mode, retain until "), F.left("lock_until", F.lit(10))))
        .otherwise("NOT LOCKED"))
    return objects.select("bucket", "key", status.alias("status"))


def plan(objects: DataFrame, streams: DataFrame, now: int) -> DataFrame:
    """One decision for every object and stream whose pattern it matches.

    In this order: an active lock is kept; a lock that is wanted and not yet due is set; what
    is expired and unlocked is deleted; all else is kept. Streams are at most a few dozen
    configured rows, so they go to every task; the bucket is an equality.
    """
    pattern = r"^s3://([^/]+)/+(.+)$"
    rules = streams.select(
        "name", "retention_days", "lock", F.regexp_extract("pattern", pattern, 1).alias("bucket"),
        t.glob_regex(F.regexp_extract("pattern", pattern, 2)).alias("_regex"))
    matched = objects.join(F.broadcast(rules), "bucket").where(F.expr("key RLIKE _regex"))
    expired = F.lit(now) >= iso_epoch(F.col("last_modified")) + F.col("retention_days") * DAY
    mode = F.coalesce(F.col("lock_mode"), F.lit(""))
    active = F.coalesce((mode != "") & (_locked_days(now) > 0), F.lit(False))
    action = (
        F.when(active, "OK_LOCKED")
        .when((mode != "") & _locked_days(now).isNull(), "UNKNOWN_LOCK")
        .when(F.col("lock") & ~expired, "LOCK")
        .when(expired, "DELETE")
        .otherwise("OK_UNLOCKED"))
    return matched.select("name", "bucket", "key", action.alias("action"))
