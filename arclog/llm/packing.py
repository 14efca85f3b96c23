"""Packing by power-of-two decomposition.

A document's ids, end id included, are cut into as many pieces of the longest length as fit
and then into one piece for each set bit of the rest. Every piece is a power of two, equal
lengths form a bucket, and each piece is a sequence of its own: no sequence crosses
documents and none is padded. A bucket is trained with a batch size that suits its length.

The cut needs nothing but the document, so there is no shuffle. Defined cases: a null text is
an empty one and gives one piece of one id; rows without id or with repeated ids are packed
row by row; extra columns are ignored; an empty table gives no rows. Sequence ids are unique
and follow the order of the input's partitions; they are the same when a task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import parts_of
from arclog.llm.tokens import KEPT_PIECES, encoded

LONGEST = 2048
END_ID = 1
#: Bytes of ids that a batch on its way to Spark holds at most, but for one long document.
BATCH_BYTES = 1 << 23


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, none above ``longest`` (itself one), that sum to n, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = END_ID, kept: int = KEPT_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    bucket, sequence_id and offset. ``kept``: bytes of pieces that a worker keeps, a matter of
    speed alone."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            texts = chain.from_iterable(parts_of(batch.column(1)))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(texts, vocabulary, kept=kept), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    for column, value in zip(rows, (doc, start, length, ids[4 * start : 4 * (start + length)], n), strict=True):
                        column.append(value)
                    start += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, held = [[], [], [], [], []], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = slim.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return found.select(
        "*",
        F.col("length").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces as one folder for each length, so that a reader takes whole batches of one."""
    packed.write.partitionBy("bucket").parquet(path)
