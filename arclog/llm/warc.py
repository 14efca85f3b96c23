"""WARC writing and reading with reassembly of segmented records.

Payloads are written as HTTP responses in chunked transfer framing. A record whose block is
longer than a segment is split: the first segment keeps the record's type and number 1, the
others are continuation records that name the first one's id as origin, and the last of them
tells the total length. Reading groups segments by origin id, orders them by number, checks
that none is missing and that the lengths add up, and decodes the chunked framing.

Equal payloads are written once: the row with the largest page id is the response, the
others revisit it. Files hold a bounded number of bytes, so a reader needs memory for one.
Each record is a gzip member of its own, as readers that seek in archives expect.

Defined cases: a null html is an empty payload. Rows without page id come before all others.
Rows that repeat page id and payload have the same record id and role; each is read back as
a row. Records that lack a segment or whose lengths or digests differ keep their row, with
``whole`` false and no payload. Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclog.llm.common import checkpointed, shared_folder
from arclog.llm.files import write_files

SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 12
FILE_BYTES = 1 << 24
#: Pages that are written together.
ROWS = 64
#: Digests that occur twice up to which they go to every task: some 100 bytes each there.
BROADCAST_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, page_id long, type string, refers_to long, payload_digest string, "
    "payload_bytes long, segment int, total long, block binary"
)


def _record_id(page_id: int | None, sha1: str) -> str:
    return uuid.UUID(hashlib.md5(f"{page_id}|{sha1}".encode()).hexdigest()).urn


def _digest(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(parts[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def records_of(page_id: int | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of one page: a revisit, a response, or a response's segments."""
    name = _record_id(page_id, sha1)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{_digest(sha1)}")]
    kind = ("Content-Type", "application/http;msgtype=response")
    if revisit:
        yield _record([("WARC-Type", "revisit"), *common, kind, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_record_id(refers_to, sha1)}>"),
            ("WARC-Refers-To-Target-URI", f"urn:page:{refers_to}"), ("Payload-Length", len(payload))], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common, kind], block)
        return
    yield _record([("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    starts = range(segment_bytes, len(block), segment_bytes)
    for number, at in enumerate(starts, 2):
        own = uuid.UUID(hashlib.md5(f"{name}|{number}".encode()).hexdigest()).urn
        total = len(block) if at == starts[-1] else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", f"urn:page:{page_id}")]
        yield _record([*fields, ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], block[at : at + segment_bytes])


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload, sha1, response_id, revisit): the larger page id of equal payloads of at
    least ``least_bytes`` bytes is the response.

    Only digests that occur twice are joined; a hot one is one row for each task before the
    shuffle that counts it. Up to ``BROADCAST_DIGESTS`` of them go to every task and payloads
    are not shuffled at all; beyond it they are joined by digest, which Spark splits where one
    is hot."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"))
    twice = checkpointed(digests.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sha1", "last", F.lit(True).alias("_twice")))
    few = twice.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    found = rows.join(F.broadcast(twice) if few else twice, "sha1", "left")
    again = F.coalesce("_twice", F.lit(False)) & (F.octet_length("payload") >= least_bytes)
    return found.select(
        "page_id", "payload", "sha1",
        F.when(again, F.col("last")).otherwise(F.col("page_id")).alias("response_id"),
        (again & ~F.col("page_id").eqNullSafe(F.col("last"))).alias("revisit"),
    )


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Records of all ``pages`` (page_id, html) as gzipped WARC files below ``path``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for part in range(0, batch.num_rows, ROWS):
                columns = [c.slice(part, ROWS).to_pylist() for c in batch.columns]
                for page_id, payload, sha1, response_id, revisit in zip(*columns, strict=True):
                    for record in records_of(page_id, payload, sha1, response_id, revisit, segment_bytes):
                        yield name, gzip.compress(record, 6, mtime=0)
                        size += len(record)
                        if size >= file_bytes:
                            name, size = f"{uuid.uuid4().hex}.warc.gz", 0

    write_files(with_roles(pages, least_bytes), write, path)


def _page(uri: str) -> int | None:
    name = uri.removeprefix("urn:page:")
    return None if name == "None" else int(name)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of unpacked WARC data, as RECORD has them. A continuation has its origin's id
    as record id."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = (line.partition(":") for line in data[at:end].decode().split("\r\n")[1:])
        fields = {name.strip().lower(): value.strip() for name, _, value in lines}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 8 + size
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
        length = fields.get("payload-length")
        yield (
            origin.strip("<>"), _page(fields["warc-target-uri"]), fields["warc-type"], _page(fields.get("warc-refers-to-target-uri", "None")),
            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, length and int(length),
            number and int(number), total and int(total), block)


def unpacked(content: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    at = 0
    while at < len(content):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut short")
            parts.append(member.decompress(content[at : at + step]))
            at += len(content[at : at + step])
        at -= len(member.unused_data)
        yield b"".join(parts)


def _read_records(spark: SparkSession, path: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in chain.from_iterable(map(parse, unpacked(memoryview(content.as_buffer())))):
                    held.append(record)
                    size += len(record[-1])
                    if size >= 1 << 22:
                        yield _batch(held, RECORD_SCHEMA)
                        held, size = [], 0
                if held:
                    yield _batch(held, RECORD_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(read, RECORD)


RECORD_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
PAGE_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("whole", pa.bool_()), ("payload", pa.binary())])
PAGE = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, whole boolean, payload binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered blocks in; payloads out, their digests checked. A total of -1 marks a missing segment."""
    for batch in batches:
        rows = []
        for name, page, kind, refers, digest, size, total, blocks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            block = b"".join(blocks)
            payload, whole = None, kind == "revisit"
            if not whole and (total is None or total == len(block)):
                head, _, body = block.partition(b"\r\n\r\n")
                try:
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError:
                    payload = None
                whole = payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                size = len(payload) if whole else None
            rows.append((name, page, kind, refers, digest, size, whole, payload if whole else None))
        if rows:
            yield _batch(rows, PAGE_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit, as PAGE has it; a revisit has no payload but its digest,
    its length and the page it refers to. Only segmented records are shuffled."""
    records = _read_records(spark, path)
    told = ("page_id", "type", "refers_to", "payload_digest", "payload_bytes")
    single = records.where("segment IS NULL").select("record_id", *told, "total", F.array("block").alias("blocks"))
    # identical records that repeat an id are so many rows, each with one set of segments
    parts = records.where("segment IS NOT NULL").groupBy("record_id", "segment").agg(
        F.first("block").alias("block"), F.max("total").alias("total"), F.count(F.lit(1)).alias("copies"),
        F.max(F.when(F.col("type") != "continuation", F.struct(*told))).alias("head"))
    joined = parts.groupBy("record_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
        F.max("total").alias("total"), F.max("head").alias("head"), F.min("copies").alias("copies"))
    last = F.array_max(F.transform("segments", lambda s: s["segment"]))
    gapless = (F.size("segments") == last) & F.col("head").isNotNull() & F.col("total").isNotNull()
    whole = joined.select(
        "record_id", *[F.col(f"head.{x}") for x in told],
        F.when(gapless, F.col("total")).otherwise(F.lit(-1)).cast("long").alias("total"),
        F.transform("segments", lambda s: s["block"]).alias("blocks"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")
    return single.union(whole.withColumn("type", F.coalesce("type", F.lit("response")))).mapInArrow(_decoded, PAGE)


def round_trip(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes all pages into a new shared folder and reads them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes, segment_bytes)
    return read_warc(pages.sparkSession, path)
