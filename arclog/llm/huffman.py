"""Token ids in files of canonical length-limited Huffman codes.

Code lengths come from the counts of all ids (package-merge, at most ``MAX_BITS`` bits), so a
codebook is one byte per id. Blocks hold whole documents and are decoded on their own. Every
``EVERY`` ids a block notes the bit offset; the runs between two offsets are decoded side by
side, one table look-up for all of them per step.

Texts are encoded where they are read and written as ids of two bytes; only those are dealt by
ranges of document ids. Where a range begins and how many ids stand before it follows from
ids and lengths alone, so each block knows its place before it is made. Ranges also cut rows
that share an id, or have none, by a number of the row, so such a group is no single range.

Layout below the folder: ``codebook.huf`` holds "HUFC", the number of ids (u32) and a length
byte for each id. ``blocks/SSSSSS-FFFFF.huf`` (range, file) hold frames "HUFB", documents
ascending by id through the files in the order of their names. All numbers are little-endian:

    4s magic, u32 documents, u64 ids of all documents before the block, u32 ids,
    u32 ids between checkpoints, u32 checkpoints, u32 payload bytes, u32 crc32 of the payload,
    then i64 document ids, u8 flags (1: the id is null), u32 ids of each document,
    u32 bit offsets, payload.

Defined cases: a null text is empty and has the end id alone; documents without id come
first; rows with the same id keep one row each, in the order they were read; extra columns are
ignored; an empty table gives no blocks and no rows. A hot source or group of copies is spread
by document id.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclog.llm.common import parts_of, shared_folder
from arclog.llm.files import opened, write_file, write_files
from arclog.llm.tokens import encoded

#: Longest code; the decoding table has two to this power entries and stays in the cache.
MAX_BITS = 16
EVERY = 256
END_ID = 2
#: Ids of a block, but for one longer document.
BLOCK_IDS = 1 << 19
#: Blocks of a file; a reader holds one file at a time.
FILE_BLOCKS = 16
#: Bytes of ids that a batch on its way to Spark holds at most, but for one long document.
BATCH_BYTES = 1 << 22

HEAD = struct.Struct("<4sIQIIIII")


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits; 0 for ids never seen."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit into {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, items, is_leaf = [], leaves, np.ones(len(leaves), bool)
    for _ in range(most - 1):
        levels.append(is_leaf)
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        items, is_leaf = both[order], order < len(leaves)
    levels.append(is_leaf)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id as a number: ascending by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    longest = int(size.max(initial=0))
    # left-aligned codes are the running sum of the shares that earlier codes take
    share = np.left_shift(np.uint64(1), (longest - size).astype(np.uint64))
    start = np.cumsum(share) - share
    codes[order] = start >> (longest - size).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every string of the longest length: the id it begins with and that id's length."""
    longest = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    share = np.left_shift(1, longest - lengths[order].astype(np.int64))
    ids = np.zeros(1 << longest, np.uint32)
    size = np.zeros(1 << longest, np.uint8)
    filled = int(share.sum())
    ids[:filled] = np.repeat(order.astype(np.uint32), share)
    size[:filled] = np.repeat(lengths[order], share)
    return ids, size, longest


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The bits of some ids and the bit offset of every ``every``-th of them."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 32 + 2, np.uint64)
    if len(ids):
        word = at >> 5
        value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        total = np.bitwise_or.reduceat(value, first)
        words[word[first]] |= total >> np.uint64(32)
        words[word[first] + 1] |= total & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], at[::every].astype(np.uint32)


def decode_ids(payload: bytes, offsets: np.ndarray, n: int, every: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a payload; the runs that start at ``offsets`` advance together."""
    ids, size, longest = table
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((len(at), every), np.uint32)
    last = n - (len(at) - 1) * every if len(at) else 0
    shift = 32 - longest
    for step in range(every if len(at) > 1 else last):
        if step == last:
            at = at[:-1]
        key = ((window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(shift)).astype(np.int64)
        out[: len(at), step] = ids[key]
        at += size[key]
    return out.reshape(-1)[:n]


def _frame(docs: np.ndarray, nulls: np.ndarray, tokens: np.ndarray, before: int, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, offsets = encode_ids(ids, codes, lengths)
    head = HEAD.pack(b"HUFB", len(docs), before, len(ids), EVERY, len(offsets), len(payload), zlib.crc32(payload))
    return b"".join([head, docs.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), tokens.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), payload])


def _tokenized(docs: DataFrame, vocabulary: str, end_id: int, n_ids: int) -> DataFrame:
    """(doc_id, n, ids): the ids of each text and the end id, two bytes each. The last row of a
    partition has n = -1 and the numbers of its ids, so they need no pass of their own."""
    end = end_id.to_bytes(2, "little")

    def rows(names: pa.Array, n: list[int], ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)

        def some(names: pa.Array, held: list[bytes]) -> pa.RecordBatch:
            total[:] += np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=n_ids)
            return rows(names, [len(x) // 2 for x in held], held)

        for batch in batches:
            first, held, size = 0, [], 0
            for ids in encoded(chain.from_iterable(parts_of(batch.column(1))), vocabulary, "H"):
                held.append(ids + end)
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield some(batch.column(0).slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield some(batch.column(0).slice(first), held)
        seen = np.flatnonzero(total)
        yield rows(pa.nulls(1, pa.int64()), [-1], [seen.astype("<u2").tobytes() + total[seen].astype("<i8").tobytes()])

    return docs.mapInArrow(tokenize, "doc_id long, n long, ids binary")


def _ranges(rows: DataFrame) -> tuple[list[tuple], list[int]]:
    """The first (known id, id, row) of every range and the ids of all documents before it: one
    row for each partition comes back."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("row").alias("row"))
    dealt = rows.select(place.alias("place"), "n").repartitionByRange(parts, "place.known", "place.id", "place.row")
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("place").alias("low"), F.sum("n").alias("n")).collect()
    found = sorted((tuple(r["low"]), r["n"]) for r in found)
    return [low for low, _ in found], [0, *accumulate(n for _, n in found)]


def _whole(column: pa.BinaryArray) -> np.ndarray:
    """The two-byte ids of all rows of a column without nulls, as they follow each other."""
    cuts = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], "<u2", (cuts[-1] - cuts[0]) // 2, cuts[0]) if len(column) and cuts[-1] > cuts[0] else np.zeros(0, "<u2")


def _counted(counts: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs; as many rows as the vocabulary has come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                seen = len(data) // 10
                total[np.frombuffer(data, "<u2", seen)] += np.frombuffer(data, "<i8", seen, 2 * seen)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(n_ids, np.int64)
    for row in counts.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, ids: int = 1 << 16) -> None:
    """Token ids of all documents, ascending by id, below ``path``. ``ids``: one more than the
    largest id of the vocabulary; two bytes each hold them between the steps."""
    if ids > 1 << 16:
        raise ValueError("vocabularies beyond 65,536 ids need wider blocks")
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scratch = f"{path}/scratch"
    _tokenized(slim, vocabulary, end_id, ids).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "snappy").parquet(scratch)
    found = spark.read.parquet(scratch)
    lengths = code_lengths(_counted(found.where("n < 0"), ids))
    rows = found.where("n >= 0")
    write_file(f"{path}/codebook.huf", b"HUFC" + struct.pack("<I", len(lengths)) + lengths.tobytes())
    lows, starts = _ranges(rows.select("doc_id", "row", "n"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            part = [bisect_right(lows, (doc is not None, doc or 0, row)) - 1 for doc, row in places]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        codes = canonical_codes(lengths)
        part, blocks, before = -1, 0, 0
        held: list[pa.RecordBatch] = []

        def frame() -> tuple[str, bytes]:
            nonlocal blocks, before
            names = pa.concat_arrays([x.column(1) for x in held])
            block = np.concatenate([_whole(x.column(3)) for x in held])
            tokens = np.diff(np.concatenate([[0], *(_lengths(x.column(3)) for x in held)]).cumsum())
            data = _frame(names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False), tokens, before, block, codes, lengths)
            name = f"{part:06d}-{blocks // FILE_BLOCKS:05d}.huf"
            held.clear()
            blocks, before = blocks + 1, before + len(block)
            return name, data

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            ends = np.cumsum(_lengths(batch.column(3)))
            at = 0
            while at < len(own):
                if own[at] != part:
                    if held:
                        yield frame()
                    part, blocks, before = int(own[at]), 0, starts[own[at]]
                room = BLOCK_IDS - sum(len(_whole(x.column(3))) for x in held)
                upto = at + 1 + int(np.searchsorted(ends[at:], (ends[at - 1] if at else 0) + room))
                upto = min(upto, len(own), int(np.searchsorted(own, part, "right")))
                held.append(batch.slice(at, upto - at))
                at = upto
                if sum(len(_whole(x.column(3))) for x in held) >= BLOCK_IDS:
                    yield frame()
        if held:
            yield frame()

    write_files(_in_ranges(rows.select("doc_id", "row", "ids").mapInArrow(deal, "part int, doc_id long, row long, ids binary"), max(1, len(lows))), frames, f"{path}/blocks")
    system, base = opened(scratch)
    system.delete_dir(base)


def _lengths(column: pa.BinaryArray) -> np.ndarray:
    """How many two-byte ids each row has."""
    return np.diff(np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)) // 2


def _in_ranges(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "row")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it),
    n_tokens and ids (little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    binary = lambda part: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{part}").select("content")
    book = bytes(binary("codebook.huf").first()["content"])
    (n,) = struct.unpack_from("<I", book, 4)
    lengths = np.frombuffer(book, np.uint8, n, 8)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for content in batch.column(0):
                yield from _read_file(content.as_buffer(), table, schema)

    return binary("blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def _read_file(content: pa.Buffer, table: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    at, view = 0, memoryview(content)
    while at < len(view):
        magic, n_docs, before, n_ids, every, n_offsets, n_payload, crc = HEAD.unpack_from(view, at)
        at += HEAD.size
        docs = np.frombuffer(view, "<i8", n_docs, at)
        nulls = np.frombuffer(view, "u1", n_docs, at + 8 * n_docs)
        tokens = np.frombuffer(view, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        offsets = np.frombuffer(view, "<u4", n_offsets, at + 13 * n_docs)
        at += 13 * n_docs + 4 * n_offsets
        payload = bytes(view[at : at + n_payload])
        at += n_payload
        if magic != b"HUFB" or zlib.crc32(payload) != crc:
            raise ValueError("a block of token ids is damaged")
        ids = decode_ids(payload, offsets, n_ids, every, table).astype("<u4")
        ends = np.cumsum(tokens)
        cuts = pa.py_buffer(np.r_[0, 4 * ends].astype("<i4").tobytes())
        column = pa.Array.from_buffers(pa.binary(), n_docs, [None, cuts, pa.py_buffer(ids.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, mask=nulls.astype(bool)), pa.array(before + ends - tokens), pa.array(tokens), column], schema=schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids into a new shared folder and reads them back."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, id_col, text_col, end_id)
    return read_tokens(docs.sparkSession, path)
