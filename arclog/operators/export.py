"""Structured export: seven text columns per line, as CSV or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclog.functions import text as t
from arclog.operators.search import Search, body


def record(line: Column, fmt: str) -> list[Column]:
    """The seven columns of a line; of what is no JSON object ``raw`` alone."""
    cells = []
    for name in t.EXPORT_COLUMNS[:-1]:
        value = F.when(t.is_json_object(line), F.coalesce(t.first_field(line, name), F.lit(""))) if fmt == "json" else F.lit(None).cast("string")
        cells.append(F.coalesce(value, F.lit("")).alias(name))
    return [*cells, t.right_trimmed(line).alias("raw")]


def export_records(chunks: DataFrame, frm=None, to=None, mode: str = "exact", fmt: str = "json", year: int = 2024) -> DataFrame:
    """The records of all lines in a time window: of whole chunks in ``reference`` mode."""
    lines = Search("", frm, to, mode=mode, fmt=fmt, year=year).run(chunks)
    return lines.select(*record(F.col("raw"), fmt))


def export_stats(chunks: DataFrame, frm=None, to=None) -> DataFrame:
    """One row: lines written and chunks read and skipped, as ``reference`` mode has them."""
    passes = Search("", frm, to, mode="reference").time_passes()
    n = F.size(F.filter(F.split(body(), "\n"), lambda x: x != "")).cast("long")
    return chunks.agg(
        F.coalesce(F.sum(F.when(passes, n)), F.lit(0)).cast("long").alias("lines"),
        F.count_if(passes).alias("chunks"), F.count_if(~passes).alias("skipped"))


def write_csv(records: DataFrame, path: str) -> None:
    """CSV with a header, which an empty export has too."""
    writer = records.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
    writer.csv(path)


def json_ascii(text: Column) -> Column:
    """JSON text with every character beyond ASCII as its \\u escapes."""
    def escaped(c: Column) -> Column:
        digits = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(F.octet_length(c) == 1, c).otherwise(F.concat(F.lit("\\u"), F.left(digits, F.lit(4)), F.when(F.length(digits) > 4, F.concat(F.lit("\\u"), F.right(digits, F.lit(4)))).otherwise("")))

    each = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(each)


def write_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object per line, in ASCII."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "false"})
    records.select(json_ascii(line).alias("value")).write.text(path)
