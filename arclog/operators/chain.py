"""The hash chain over an archive's chunks: building it is sequential for each archive,
checking it is not."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link(previous: Column, raw: Column) -> Column:
    """The hash of a chunk: of the hash before it (none for the first) and its bytes."""
    before = F.coalesce(F.unhex(previous), F.lit(b""))
    return F.sha2(F.concat(before, raw.cast("binary")), 256)


def with_chain(chunks: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """``chunks`` with ``chunk_hash``. An archive's chunks stream through one task in order,
    one chunk at a time, as each hash needs the one before; archives run side by side.
    ``seeds``: the last hash of archives that go on."""
    seeds = seeds or {}
    order = chunks.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, last = None, b""
        for batch in batches:
            names, raws = (batch.column(order.index(c)).to_pylist() for c in ("archive_id", "raw"))
            hashes = []
            for name, raw in zip(names, raws, strict=True):
                if name != archive:
                    archive, last = name, bytes.fromhex(seeds.get(name, ""))
                last = hashlib.sha256(last + raw).digest()
                hashes.append(last.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], names=[*order, "chunk_hash"])

    # bodies may be no UTF-8, so they travel as bytes
    kind = chunks.schema["raw"].dataType
    bytes_ = chunks.withColumn("raw", F.col("raw").cast("binary"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bytes_.schema.fields)
    linked = bytes_.repartition("archive_id").sortWithinPartitions("archive_id", "seq").mapInArrow(fold, f"{fields}, chunk_hash string")
    return linked.withColumn("raw", F.col("raw").cast(kind))


def heads(chunks: DataFrame) -> DataFrame:
    """(archive_id, num_chunks, chain_hash): the footer of every archive."""
    return chunks.groupBy("archive_id").agg(F.count(F.lit(1)).alias("num_chunks"), F.max_by("chunk_hash", "seq").alias("chain_hash"))


def checked(chunks: DataFrame) -> DataFrame:
    """(archive_id, seq, chunk_hash, got, bad) for each chunk on its own.

    Up to the first bad chunk the stored hash before a chunk is the true one, so comparing
    each with the hash made of the stored one before it finds the same first bad chunk as a
    walk from the start; a join by number instead of a walk."""
    before = chunks.select("archive_id", (F.col("seq") + 1).alias("seq"), F.col("chunk_hash").alias("previous"))
    got = chunks.join(before, ["archive_id", "seq"], "left").withColumn("got", link(F.col("previous"), F.col("raw")))
    return got.select("archive_id", "seq", "chunk_hash", "got", (F.col("got") != F.col("chunk_hash")).alias("bad"))


def verify(chunks: DataFrame, archives: DataFrame) -> DataFrame:
    """One verdict per archive: VERIFIED, or TAMPERED with the first bad chunk, or a footer that
    does not agree. An archive without chunks is VERIFIED and has no chain."""
    found = checked(chunks).groupBy("archive_id").agg(
        F.min(F.when(F.col("bad"), F.col("seq"))).alias("bad_chunk"),
        F.min_by(F.when(F.col("bad"), F.col("chunk_hash")), F.when(F.col("bad"), F.col("seq"))).alias("expected"),
        F.min_by(F.when(F.col("bad"), F.col("got")), F.when(F.col("bad"), F.col("seq"))).alias("got"),
        F.count(F.lit(1)).alias("n"), F.max_by("chunk_hash", "seq").alias("last"))
    told = archives.select("archive_id", "num_chunks", "chain_hash").join(found, "archive_id", "left")
    chunk_bad = F.col("bad_chunk").isNotNull()
    footer_bad = F.coalesce((F.col("n") != F.col("num_chunks")) | (F.col("last") != F.col("chain_hash")), F.col("num_chunks") > 0)
    head = lambda c: F.left(F.lower(c), F.lit(16))
    return told.select(
        "archive_id",
        F.when(chunk_bad | footer_bad, "TAMPERED").otherwise("VERIFIED").alias("status"),
        F.col("num_chunks").cast("long").alias("num_chunks"),
        "bad_chunk",
        F.when(chunk_bad, "chunk").when(footer_bad, "footer").otherwise("").alias("reason"),
        head(F.when(chunk_bad, F.col("expected")).when(footer_bad, F.col("chain_hash"))).alias("expected16"),
        head(F.when(chunk_bad, F.col("got")).when(footer_bad, F.col("last"))).alias("got16"),
        head(F.when(~chunk_bad & ~footer_bad, F.col("chain_hash"))).alias("chain16"))
