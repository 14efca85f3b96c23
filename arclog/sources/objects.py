"""Object stores: what is there, and the few actions that retention may take.

Listing goes through Spark's file index, which any Hadoop file system serves. Locks are no
part of that interface, so they come from an ``ObjectStore``; nothing here changes a store
unless such an object is given and a dry run is declined.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = r"^[a-z0-9]+:/*([^/]+)/+(.+)$"


class ObjectStore(Protocol):
    def set_retention(self, bucket: str, key: str, until: str) -> None: ...

    def delete(self, bucket: str, key: str) -> None: ...

    def check_lock(self, bucket: str, key: str) -> tuple[str, str]: ...

    def put(self, bucket: str, key: str, data: bytes, mode: str = "", until: str = "") -> None: ...


class FileStore:
    """A store in a folder: a file for each object and one beside it for its lock. A locked object
    is neither replaced nor deleted, and a lock is only ever made longer."""

    def __init__(self, root: str, now: str):
        self.root, self.now = Path(root), now

    def _file(self, bucket: str, key: str) -> Path:
        return self.root / quote(bucket, safe="") / quote(key, safe="")

    def _lock(self, bucket: str, key: str) -> Path:
        return self._file(bucket, key).with_name(quote(key, safe="") + "@lock")  # no quoted key has an @

    def check_lock(self, bucket: str, key: str) -> tuple[str, str]:
        """(mode, date) of a lock; empty without one. An object that is not there is an error."""
        if not self._file(bucket, key).exists():
            raise FileNotFoundError(f"{bucket}/{key}")
        lock = self._lock(bucket, key)
        return tuple(json.loads(lock.read_text())) if lock.exists() else ("", "")

    def _refuse_locked(self, bucket: str, key: str) -> None:
        if self._file(bucket, key).exists() and self.check_lock(bucket, key)[1] > self.now:
            raise PermissionError(f"{bucket}/{key} is locked")

    def set_retention(self, bucket: str, key: str, until: str, mode: str = "COMPLIANCE") -> None:
        if until < self.check_lock(bucket, key)[1]:
            raise PermissionError(f"{bucket}/{key} is locked for longer")
        self._lock(bucket, key).write_text(json.dumps([mode, until]))

    def put(self, bucket: str, key: str, data: bytes, mode: str = "", until: str = "") -> None:
        self._refuse_locked(bucket, key)
        file = self._file(bucket, key)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
        self._lock(bucket, key).unlink(missing_ok=True)
        if mode:
            self.set_retention(bucket, key, until, mode)

    def delete(self, bucket: str, key: str) -> None:
        self._refuse_locked(bucket, key)
        self._file(bucket, key).unlink()
        self._lock(bucket, key).unlink(missing_ok=True)

    def table(self, spark: SparkSession) -> DataFrame:
        """The objects as retention reads them."""
        rows = []
        for file in sorted(self.root.glob("*/*")):
            if not file.name.endswith("@lock"):
                bucket, key = unquote(file.parent.name), unquote(file.name)
                changed = datetime.fromtimestamp(file.stat().st_mtime, UTC).strftime("%Y-%m-%dT%H:%M:%S")
                rows.append((bucket, key, changed, *self.check_lock(bucket, key)))
        return spark.createDataFrame(rows, "bucket string, key string, last_modified string, lock_mode string, lock_until string")


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(bucket, key, last_modified, lock_mode, lock_until) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    utc = F.date_format(F.to_utc_timestamp("modificationTime", spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss")
    return files.select(
        F.regexp_extract("path", PATTERN, 1).alias("bucket"), F.regexp_extract("path", PATTERN, 2).alias("key"),
        utc.alias("last_modified"), F.lit("").alias("lock_mode"), F.lit("").alias("lock_until"))


def apply(plan: DataFrame, store: ObjectStore | None, until: str = "", dry_run: bool = True) -> dict[str, int]:
    """Carries out a plan's locks and deletions one by one; returns how many rows each action
    has. A dry run, the default, only counts."""
    counts = {row["action"]: row["count"] for row in plan.groupBy("action").count().collect()}
    if not dry_run and store is not None:
        for row in plan.where(F.col("action").isin("LOCK", "DELETE")).toLocalIterator():
            if row["action"] == "LOCK":
                store.set_retention(row["bucket"], row["key"], until)
            else:
                store.delete(row["bucket"], row["key"])
    return counts
