"""Search with chunk pruning.

``exact`` finds every line that matches: chunks are skipped only where the index proves that
no line of theirs can, and each line is tested. ``reference`` has the reference semantics:
time and field filters choose whole chunks, and a query is looked up by its whole tokens, so
that parts of tokens may be missed. Over a stored archive, ``archive.search`` looks the index
up first and opens only the parts that it leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclog.functions import bloom
from arclog.functions import text as t
from arclog.functions.times import date_bound, line_epoch

FIELDS = ("user", "ip", "action", "level")


def body() -> Column:
    """A chunk's text as it is searched and shown: bytes that are no UTF-8 are U+FFFD."""
    return F.make_valid_utf8(F.col("raw"))


def _and(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


class Search:
    """One search: which chunks it reads, which lines it returns, what it counts."""

    def __init__(self, query: str = "", frm=None, to=None, user=None, ip=None, action=None, level=None, mode: str = "exact",
                 fmt: str = "json", year: int = 2024, text_bits: int = bloom.TEXT_BITS):
        if mode not in ("exact", "reference"):
            raise ValueError(f"no such mode: {mode}")
        self.query, self.mode, self.fmt, self.year, self.text_bits = query, mode, fmt, year, text_bits
        self.start, self.end = date_bound(frm), date_bound(to, end=True)
        # an empty value is no filter
        self.fields = {k: v for k, v in zip(FIELDS, (user, ip, action, level), strict=True) if v}

    def time_passes(self) -> Column:
        """Whether a chunk's times touch the window; chunks without times do."""
        parts = []
        if self.start is not None:
            parts.append(F.col("max_ts").isNull() | (F.col("max_ts") >= self.start))
        if self.end is not None:
            parts.append(F.col("min_ts").isNull() | (F.col("min_ts") <= self.end))
        return _and(parts)

    def fields_pass(self) -> Column:
        """Whether a chunk may have all values, under whatever key; chunks without filter may."""
        if not self.fields:
            return F.lit(True)
        return F.col("field_bloom").isNull() | bloom.has_all(F.col("field_bloom"), list(self.fields.values()), bloom.FIELD_BITS)

    def text_passes(self) -> Column:
        if not self.query:
            return F.lit(True)
        wanted = t.interior_tokens(self.query) if self.mode == "exact" else t.query_tokens(self.query)
        return F.col("bloom").isNull() | bloom.has_all(F.col("bloom"), wanted, self.text_bits)

    def prunes(self, index: DataFrame) -> DataFrame:
        """What the index leaves; it needs no text. A filter that is not there may hold anything."""
        return index.where(self.time_passes()).where(self.fields_pass()).where(self.text_passes())

    def survivors(self, chunks: DataFrame) -> DataFrame:
        """Chunks whose lines are tested: what the index leaves and the body may have."""
        kept = self.prunes(chunks)
        return kept.where(F.contains(body(), F.lit(self.query))) if self.query else kept

    def line_matches(self, line: Column) -> Column:
        parts = [line != ""]
        if self.query:
            parts.append(F.contains(line, F.lit(self.query)))
        if self.mode == "exact":
            if self.start is not None or self.end is not None:
                ts = line_epoch(line, F.lit(self.fmt), self.year)
                parts += [ts >= self.start] if self.start is not None else []
                parts += [ts <= self.end] if self.end is not None else []
            parts += [t.is_json_object(line) & (t.first_field(line, k) == v) for k, v in self.fields.items()]
        return F.coalesce(_and(parts), F.lit(False))

    def run(self, chunks: DataFrame) -> DataFrame:
        """(archive_id, chunk_id, raw): one row per matching line."""
        return self.lines(self.survivors(chunks))

    def lines(self, survivors: DataFrame) -> DataFrame:
        lines = survivors.select("archive_id", "chunk_id", F.explode(F.split(body(), "\n")).alias("raw"))
        return lines.where(self.line_matches(F.col("raw")))

    def reason(self) -> Column:
        """The layer that skips a chunk, the first that does; null where it is read."""
        return F.when(~self.time_passes(), "time").when(~self.fields_pass(), "field").when(~self.text_passes(), "bloom")

    def matches(self) -> Column:
        """How many lines of a chunk match."""
        return F.size(F.filter(F.split(body(), "\n"), self.line_matches)).cast("long")

    @staticmethod
    def counted(each: DataFrame) -> DataFrame:
        """One row: chunks in all, scanned, skipped by each layer, matches."""
        skipped = [F.sum(F.when(F.col("reason") == r, F.col("_chunk")).otherwise(0)).alias(f"skipped_by_{r}") for r in ("time", "field", "bloom")]
        found = each.agg(F.sum("_chunk").alias("total"), F.sum(F.when(F.col("reason").isNull(), F.col("_chunk")).otherwise(0)).alias("scanned"), *skipped, F.sum("n").alias("matches"))
        return found.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in found.columns])

    def stats(self, chunks: DataFrame) -> DataFrame:
        """One row as ``counted`` has it, for chunks whose index and text are one table."""
        read = self.reason().isNull() & F.contains(body(), F.lit(self.query))
        return self.counted(chunks.select(F.lit(1).alias("_chunk"), self.reason().alias("reason"), F.when(read, self.matches()).otherwise(0).alias("n")))


def search(chunks: DataFrame, query: str = "", **options) -> DataFrame:
    return Search(query, **options).run(chunks)
