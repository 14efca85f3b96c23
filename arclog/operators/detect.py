"""The format of an archive, from its first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclog.functions import text as t

SAMPLE_LINES = 5


def _first(lines: DataFrame) -> DataFrame:
    """The first lines of every archive: kept by the task, so a sort of all lines is not needed."""
    least = F.expr(f"slice(array_sort(collect_list(struct(line_no, raw))), 1, {SAMPLE_LINES})")
    head = lines.groupBy("archive_id", F.floor(F.col("line_no") / 65536).alias("_g")).agg(F.min("line_no").alias("n"))
    first = head.groupBy("archive_id").agg(F.min("_g").alias("_g"))
    near = lines.join(F.broadcast(first), "archive_id").where(F.col("line_no") < (F.col("_g") + 1) * 65536 + SAMPLE_LINES)
    return near.groupBy("archive_id").agg(least.alias("_head")).select("archive_id", F.inline("_head"))


def detect_format(lines: DataFrame) -> DataFrame:
    """(archive_id, format): the format that three of the first five lines have, or all of fewer."""
    votes = _first(lines).groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.is_json(F.col("raw"))).alias("json"), F.count_if(t.is_syslog(F.col("raw"))).alias("syslog"))
    needed = F.greatest(F.lit(1), F.least(F.lit(3), F.col("n")))
    return votes.select("archive_id", F.when(F.col("json") >= needed, "json").when(F.col("syslog") >= needed, "syslog").otherwise("plaintext").alias("format"))


def detect_format_quick(lines: DataFrame) -> DataFrame:
    """(archive_id, format): two of the first five lines that are not blank, by the quick tests."""
    votes = _first(lines.where("raw <> ''")).groupBy("archive_id").agg(
        F.count_if(t.looks_like_json(F.col("raw"))).alias("json"), F.count_if(t.looks_like_syslog(F.col("raw"))).alias("syslog"))
    return votes.select("archive_id", F.when(F.col("json") >= 2, "json").when(F.col("syslog") >= 2, "syslog").otherwise("plaintext").alias("format"))
