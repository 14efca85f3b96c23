"""Lines dealt to chunks of 64 KiB by the offset of their first byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_BYTES = 65536
#: Line numbers of a group; offsets are summed by group first, so no task orders a whole archive.
GROUP_LINES = 1 << 16


def with_chunks(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES, start: int = 0) -> DataFrame:
    """``lines`` (archive_id, line_no, raw) with ``end``, ``offset`` and ``chunk_id``.

    ``end`` tells whether a line has its line end; where the column is missing every line has.
    A line and its end count; a line belongs to the chunk of its first byte, so chunks never
    cut lines. Sums of whole groups of line numbers give each group its start; only within a
    group are lines ordered. Two shuffles, of slim rows and of lines.
    """
    if "end" not in lines.columns:
        lines = lines.withColumn("end", F.lit(True))
    sized = lines.withColumn("_size", F.octet_length("raw").cast("long") + F.col("end").cast("long")).withColumn("_group", F.floor(F.col("line_no") / GROUP_LINES))
    groups = sized.groupBy("archive_id", "_group").agg(F.sum("_size").alias("_bytes"))
    order = Window.partitionBy("archive_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("archive_id", "_group", F.coalesce(F.sum("_bytes").over(order), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("archive_id", "_group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["archive_id", "_group"]).withColumn(
        "offset", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)) + F.lit(start))
    return placed.withColumn("chunk_id", F.floor(F.col("offset") / chunk_bytes).cast("long")).drop("_size", "_group", "_start")


def byte_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files (path, content) cut into byte chunks regardless of lines: (path, chunk_id, raw)."""
    n = F.greatest(F.ceil(F.octet_length("content") / chunk_bytes).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return files.where(F.octet_length("content") > 0).select("path", F.posexplode(cut).alias("chunk_id", "raw"))
