"""Files of the seekable ``logz`` format, read and written through a Python Data Source.

    spark.dataSource.register(LogzSource)
    spark.read.format("logz").load("archive.logz")
    df.write.format("logz").option("format", "json").save("archive.logz")

A file has a header with a shared zstd dictionary, compressed chunks, an index row for each
chunk and a footer. The reader looks at footer and index on the driver, drops the chunks that
the options exclude (``query``, ``from``, ``to``, ``user``, ``ip``, ``action``, ``level``, all with
the reference semantics) and makes a partition of each run of chunks left, so that executors
fetch and decode nothing else. Chunks are byte slices here: lines may span two of them.

The file's folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import chain, islice

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from arclog.functions import text as t
from arclog.functions.bloom import FIELD_BITS, TEXT_BITS, bitmap
from arclog.functions.times import date_bound

# Fixed values of the format, all numbers little-endian.
# Header: magic, u16 version, u8 log format, u32 dictionary bytes, dictionary.
# Index row: u64 offset, u32 compressed bytes, u32 original bytes, text filter, SHA-256 link,
# u64 first and last epoch second (0: none), field filter.
# Footer: SHA-256 of the last link, u64 offset of the index, u32 number of chunks.
MAGIC = b"LOGZ"
VERSION = 4
HEADER = struct.Struct("<4sHBI")
ENTRY = struct.Struct("<QII1024s32sQQ512s")
FOOTER = struct.Struct("<32sQI")
CHUNK = 65536
DICT_BYTES = 112 * 1024
TRAIN_BYTES = 10 * 1024 * 1024
LEVEL = 3
FORMATS = ("json", "syslog", "plaintext")

SCHEMA = "chunk_id long, orig_size long, min_ts long, max_ts long, chunk_hash string, raw binary"


def holds(bloom: bytes, value: bytes, bits: int) -> bool:
    return all(bloom[h % bits >> 3] >> (h % bits & 7) & 1 for h in t.py_hashes(value))


def _tokens(raw: bytes) -> list[bytes]:
    return [x for x in re.split(t.TOKEN_SPLIT.encode(), raw) if x]


def _objects(raw: bytes) -> Iterator[dict]:
    for line in raw.split(b"\n"):
        try:
            value = json.loads(line.decode("utf-8", "replace")) if line else None
        except ValueError:
            continue
        if isinstance(value, dict):
            yield value


def _epoch(value: object) -> int | None:
    if isinstance(value, int | float) and not isinstance(value, bool):
        return int(value) if 1e9 <= value <= 9e9 else None
    try:
        return date_bound(value) if isinstance(value, str) else None
    except ValueError:
        return None


def _times(raw: bytes, fmt: str, year: int) -> list[int]:
    found = []
    if fmt != "syslog":
        for row in _objects(raw):
            found += [x for x in (_epoch(row.get(k)) for k in t.ALIASES["timestamp"]) if x is not None][:1]
    if fmt != "json":
        for m in re.finditer(rb"(?m)^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d\d):(\d\d):(\d\d)\s", raw):
            try:
                month = t.MONTHS.index(m[1].decode()) + 1
                found.append(int(datetime(year, month, *map(int, m.groups()[1:]), tzinfo=timezone.utc).timestamp()))
            except ValueError:
                continue
    return found


@dataclass
class Index:
    """What a reader knows of a file before it opens a chunk."""

    format: str
    dictionary: bytes
    chain_hash: bytes
    entries: list[tuple]

    @classmethod
    def of(cls, path: str) -> Index:
        with open(path, "rb") as f:
            magic, version, fmt, n_dict = HEADER.unpack(f.read(HEADER.size))
            if magic != MAGIC or version != VERSION:
                raise ValueError(f"{path} is no logz file of version {VERSION}")
            dictionary = f.read(n_dict)
            f.seek(-FOOTER.size, os.SEEK_END)
            chain_hash, at, n = FOOTER.unpack(f.read(FOOTER.size))
            f.seek(at)
            return cls(FORMATS[fmt], dictionary, chain_hash, [ENTRY.unpack(f.read(ENTRY.size)) for _ in range(n)])


def surviving(index: Index, options: dict[str, str]) -> tuple[list[int], dict[str, int]]:
    """The chunks that the options leave, and how many each layer has skipped."""
    start, end = date_bound(options.get("from")), date_bound(options.get("to"), end=True)
    fields = [options[k].encode() for k in ("user", "ip", "action", "level") if options.get(k)]
    query = options.get("query") or ""
    kept, skipped = [], {"time": 0, "field": 0, "bloom": 0}
    for i, (_, _, _, bloom, _, low, high, field_bloom) in enumerate(index.entries):
        timed = low or high
        if timed and ((start is not None and high < start) or (end is not None and low > end)):
            skipped["time"] += 1
        elif fields and any(field_bloom) and not all(holds(field_bloom, v, FIELD_BITS) for v in fields):
            skipped["field"] += 1
        elif query and not all(holds(bloom, x.encode(), TEXT_BITS) for x in t.query_tokens(query)):
            skipped["bloom"] += 1
        else:
            kept.append(i)
    return kept, skipped


class Run(InputPartition):
    """Neighbouring chunks that one task reads."""

    def __init__(self, first: int, entries: list[tuple]):
        super().__init__(first)
        self.first, self.entries = first, entries


class LogzReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file:")
        self.options = dict(options)
        self.run_chunks = int(options.get("chunksperpartition", "64"))
        self.dictionary = Index.of(self.path).dictionary

    def partitions(self) -> list[Run]:
        index = Index.of(self.path)
        kept, _ = surviving(index, self.options)
        runs: list[Run] = []
        for i in kept:
            if runs and runs[-1].first + len(runs[-1].entries) == i and len(runs[-1].entries) < self.run_chunks:
                runs[-1].entries.append(index.entries[i])
            else:
                runs.append(Run(i, [index.entries[i]]))
        return runs

    def read(self, partition: Run | None) -> Iterator[tuple]:
        import zstandard

        if partition is None:  # Spark's stand-in where no chunk is left
            return
        shared = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
        decoder = zstandard.ZstdDecompressor(dict_data=shared)
        with open(self.path, "rb") as f:
            for i, (at, size, original, _, link, low, high, _) in enumerate(partition.entries, partition.first):
                f.seek(at)
                raw = decoder.decompress(f.read(size), max_output_size=original)
                if len(raw) != original:
                    raise ValueError(f"chunk {i} has {len(raw)} bytes, not {original}")
                yield i, original, low or None, high or None, link.hex(), raw


@dataclass
class Part(WriterCommitMessage):
    path: str


class LogzWriter(DataSourceWriter):
    """Writes lines (line_no, raw) as one file. Its chain makes the format sequential: tasks
    leave their lines in order in files beside it, and the driver merges these as it writes,
    so it holds a chunk and the index at a time. For exchange only; archives are tables."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path = options["path"].removeprefix("file:")
        self.format = options.get("format", "plaintext")
        self.year = int(options.get("year", "2024"))
        self.at, self.raw = columns.index("line_no"), columns.index("raw")

    def write(self, rows: Iterator) -> Part:
        lines = sorted((r[self.at], (r[self.raw] or "").encode()) for r in rows)
        os.makedirs(f"{self.path}.parts", exist_ok=True)
        part = Part(f"{self.path}.parts/{uuid.uuid4().hex}")
        with open(part.path, "wb") as f:
            for at, raw in lines:
                f.write(LINE.pack(at, len(raw)) + raw)
        return part

    def commit(self, messages: list[Part]) -> None:
        parts = [_lines_in(m.path) for m in messages if m is not None]
        write_file(self.path, _slices(raw + b"\n" for _, raw in heapq.merge(*parts)), self.format, self.year)
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)

    def abort(self, messages: list[Part]) -> None:
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)


LINE = struct.Struct("<qI")


def _lines_in(path: str) -> Iterator[tuple[int, bytes]]:
    with open(path, "rb") as f:
        while head := f.read(LINE.size):
            at, size = LINE.unpack(head)
            yield at, f.read(size)


def _slices(pieces: Iterable[bytes], size: int = 1 << 16) -> Iterator[bytes]:
    """Bytes in slices of one size, the last one shorter."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def write_file(path: str, data: bytes | Iterator[bytes], fmt: str, year: int = 2024) -> None:
    """Bytes, or slices of ``CHUNK`` bytes, as a logz file."""
    import zstandard

    slices = _slices([data], CHUNK) if isinstance(data, bytes) else data
    samples = list(islice(slices, TRAIN_BYTES // CHUNK))
    dictionary = b""
    if len(samples) >= 2:
        try:
            dictionary = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            dictionary = b""
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    link, entries = b"", []
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(HEADER.pack(MAGIC, VERSION, FORMATS.index(fmt), len(dictionary)) + dictionary)
        for raw in chain(samples, slices):
            link = hashlib.sha256(link + raw).digest()
            seen = _times(raw, fmt, year)
            values = [str(v).encode() for row in _objects(raw) for v in (row.get(k) for k in t.FIELD_KEYS) if v is not None] if fmt == "json" else []
            body = coder.compress(raw)
            entries.append(ENTRY.pack(f.tell(), len(body), len(raw), bitmap(_tokens(raw), TEXT_BITS), link, min(seen, default=0), max(seen, default=0), bitmap(values, FIELD_BITS)))
            f.write(body)
        at = f.tell()
        f.write(b"".join(entries) + FOOTER.pack(link or bytes(32), at, len(entries)))
    os.replace(f"{path}.part", path)


class LogzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogzReader:
        return LogzReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> LogzWriter:
        return LogzWriter({k.lower(): v for k, v in self.options.items()}, schema.fieldNames())
