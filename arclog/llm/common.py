"""Small things that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Columns of ``documents`` that every pipeline stage hands on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes that a store of a Python worker holds at most, and the longest key that it takes.
KEPT_BYTES = 32 << 20
KEPT_KEY = 64
#: What a short word and its value take in a dictionary besides the word's characters.
ENTRY_BYTES = 200


class Kept(dict):
    """Values by word; what is not there is made by ``make``. At most ``most`` bytes are held: when
    they are full the first quarter stays, as the words that come first are the common ones.
    Longer words than KEPT_KEY are never kept."""

    def __init__(self, make: Callable[[str], Any], most: int = KEPT_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key: str) -> Any:
        value = self.make(key)
        if len(key) <= KEPT_KEY:
            self.held += len(key) + ENTRY_BYTES
            if self.held > self.most:
                self._shrink()
                self.held += len(key) + ENTRY_BYTES
            self[key] = value
        return value

    def _shrink(self) -> None:
        first = dict(islice(self.items(), len(self) // 4))
        self.clear()
        self.update(first)
        self.held = sum(map(len, first)) + len(first) * ENTRY_BYTES


_WORKER: dict[Hashable, Any] = {}


def of_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task under ``key``. There is one thing at a time:
    what a stage kept goes when the next stage asks for its own."""
    if key not in _WORKER:
        _WORKER.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves or not at all
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _WORKER[key] = make()
    return _WORKER[key]


def parts_of(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of a column, so many at once: a batch is never a second time in memory."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it.

    Catalyst may inline an expression into a lambda and evaluate it for every element; a
    lambda variable is evaluated once, so heavy arrays are bound through one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, local sessions use
    /tmp/checkpoints and others a folder beside the warehouse, which executors share.
    """
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        default = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or default)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the next with underscores before it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model here learns from: crc32 of the id as text leaves 1 over 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
