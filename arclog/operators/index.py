"""Chunks with their index: time zone, text filter, field filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclog.functions import bloom
from arclog.functions import text as t
from arclog.functions.times import line_epoch
from arclog.operators.chunking import CHUNK_BYTES, with_chunks

KEY = ["archive_id", "chunk_id"]
TOKEN_BYTES = t.TOKEN_SPLIT.encode()


def time_zones(placed: DataFrame, fmt: str, year: int = 2024) -> DataFrame:
    """(archive_id, chunk_id, min_ts, max_ts): null where no line has a time."""
    timed = placed.select(*KEY, line_epoch(F.col("raw"), F.lit(fmt), year).alias("ts"))
    return timed.groupBy(*KEY).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def first_last_times(placed: DataFrame, fmt: str, year: int = 2024) -> DataFrame:
    """The first and the last time found in a chunk: right for ordered logs only."""
    timed = placed.select(*KEY, "line_no", line_epoch(F.col("raw"), F.lit(fmt), year).alias("ts")).where("ts IS NOT NULL")
    return timed.groupBy(*KEY).agg(F.min_by("ts", "line_no").alias("first_ts"), F.max_by("ts", "line_no").alias("last_ts"))


def token_positions(placed: DataFrame, bits: int = bloom.TEXT_BITS) -> DataFrame:
    """(archive_id, chunk_id, bit) of every distinct token of a chunk; bits may repeat."""
    each = placed.select(*KEY, F.explode(F.array_distinct(t.tokens(F.col("raw")))).alias("token")).distinct()
    return each.select(*KEY, F.explode(bloom.positions(F.col("token"), bits)).alias("bit"))


def field_positions(placed: DataFrame, bits: int = bloom.FIELD_BITS) -> DataFrame:
    """(archive_id, chunk_id, bit) of every distinct field value of a chunk."""
    each = placed.select(*KEY, F.explode(t.field_values(F.col("raw"))).alias("value")).distinct()
    return each.select(*KEY, F.explode(bloom.positions(F.col("value"), bits)).alias("bit"))


def build_chunks(lines: DataFrame, fmt: str, year: int = 2024, chunk_bytes: int = CHUNK_BYTES, text_bits: int = bloom.TEXT_BITS, start: int = 0, filters: bool = True) -> DataFrame:
    """One row per chunk with everything but its chain link. Bodies are the lines' bytes as they
    are, a line end behind each line that has one; what looks into lines sees bytes that are no
    UTF-8 as U+FFFD.

    Lines are shuffled once to their chunk; times and field values are found before, line by
    line, and the two filters are made from a chunk's row as it stands, in Arrow batches, so
    nothing is joined to the text again but the chunk's number. A chunk without field values
    has a null field filter; without ``filters`` both are null, for readers that skip nothing.
    """
    placed = with_chunks(lines, chunk_bytes, start)
    text = F.make_valid_utf8(F.col("raw"))
    found = placed.select(
        *KEY, "offset", F.struct("line_no", F.concat("raw", F.when(F.col("end"), "\n").otherwise("")).alias("raw")).alias("line"), line_epoch(text, F.lit(fmt), year).alias("ts"),
        (t.field_values(text) if fmt == "json" else F.array().cast("array<string>")).alias("values"))
    ordered = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["raw"])
    body = found.groupBy(*KEY).agg(
        F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n_lines"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.array_join(ordered, "").alias("raw"), F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))
    order = ["archive_id", "chunk_id", "offset", "n_lines", "min_ts", "max_ts", "raw"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values = batch.column(6), batch.column(7)
            text = [bloom.bitmap(set(re.split(TOKEN_BYTES, x.as_py())) - {b""}, text_bits) for x in texts]
            field = [bloom.bitmap({v.encode() for v in x.as_py()}, bloom.FIELD_BITS) if len(x) else None for x in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(text, pa.binary()), pa.array(field, pa.binary())], names=[*order, "bloom", "field_bloom"])

    empty = F.lit(None).cast("binary")
    chunks = body.select(*order, empty.alias("bloom"), empty.alias("field_bloom")) if not filters else body.withColumn("raw", F.col("raw").cast("binary")).select(*order, "values").mapInArrow(
        add, "archive_id string, chunk_id long, offset long, n_lines long, min_ts long, max_ts long, raw binary, bloom binary, field_bloom binary").withColumn("raw", F.col("raw").cast("string"))
    # numbers without gaps, from line sizes alone
    numbered = placed.select(*KEY).distinct().withColumn("seq", F.row_number().over(Window.partitionBy("archive_id").orderBy("chunk_id")).cast("long") - 1)
    return chunks.join(numbered, KEY).select(
        *KEY, "seq", "offset", "n_lines", F.octet_length("raw").cast("long").alias("orig_size"), "min_ts", "max_ts", "bloom", "field_bloom", "raw")
