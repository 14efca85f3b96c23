"""Binary files of a job in a shared folder, written by its tasks and published by the driver.

A task writes each file under a name of its own below ``_attempts`` and returns that name with
the final one as a row. Only the rows of tasks that ended well come back, so what a lost or
repeated attempt has written is never published; the driver moves the others to their names
and removes the rest. Folders are any that Arrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path) if colon else (fs.LocalFileSystem(), path)


def write_file(path: str, data: bytes) -> None:
    """One file, from the driver."""
    system, name = opened(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        out.write(data)


def write_files(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[str, bytes]]], path: str) -> None:
    """Files below ``path`` from ``make``, which turns a partition into (name, data) pairs. Pairs
    of one name follow each other and become one file; no other partition may use the name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(path)
        done, out = [], None
        try:
            for name, data in make(batches):
                if not done or done[-1][1] != name:
                    if out:
                        out.close()
                    done.append((uuid.uuid4().hex, name))
                    out = system.open_output_stream(f"{base}/_attempts/{done[-1][0]}", compression=None)
                out.write(data)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["attempt", "name"])

    system, base = opened(path)
    system.create_dir(f"{base}/_attempts", recursive=True)
    for row in rows.mapInArrow(write, "attempt string, name string").collect():
        system.move(f"{base}/_attempts/{row['attempt']}", f"{base}/{row['name']}")
    system.delete_dir(f"{base}/_attempts")
