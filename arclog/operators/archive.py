"""Archives as tables: ``bodies``, ``index`` and ``archives`` below one folder.

``bodies`` has the chunks, in parts of ``PART_CHUNKS`` neighbours; ``index`` has the same rows
without their text, so a search reads texts only of parts in which the index leaves a chunk.
Both are written first, the archive's row last; readers take the newest row of an archive
and only what it counts, so an append that fails half-way changes nothing.

An archive's row ends the hash chain over its bytes (``chain_hash``) and has the root of a
hash tree over its index (``index_hash``), so a changed filter or time is found as well.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclog.operators import chain, detect
from arclog.operators.index import build_chunks
from arclog.operators.search import Search

#: Chunks of a part: what is read where the index leaves one of them.
PART_CHUNKS = 256
#: Parts that a search names one by one; beyond them all bodies are scanned.
NAMED_PARTS = 2000
#: Index entries that one node of the hash tree covers, and its levels.
TREE = 4096
LEVELS = 3

ARCHIVE = (
    "archive_id string, version int, format string, chain_hash string, num_chunks long, orig_size long, next_chunk long, "
    "index_hash string, batch string"
)
_CHUNK = (
    "chunk_id long, seq long, offset long, n_lines long, orig_size long, min_ts long, max_ts long, bloom binary, field_bloom binary, "
    "chunk_hash string, part long, archive_id string, version int"
)
TABLES = {"bodies": "raw string, " + _CHUNK, "index": "index_hash string, " + _CHUNK}
EMPTY = {"version": 0, "chain_hash": None, "num_chunks": 0, "orig_size": 0, "next_chunk": 0}
ENTRY = ("seq", "chunk_id", "offset", "n_lines", "orig_size", "min_ts", "max_ts", "bloom", "field_bloom", "chunk_hash")


def entry_hash() -> Column:
    """The hash of an index entry: all its columns, nulls told from empty ones."""
    text = lambda c: F.hex(c) if "bloom" in c else F.col(c).cast("string")
    return F.sha2(F.array_join(F.array(*[F.coalesce(text(c), F.lit("-")) for c in ENTRY]), "|").cast("binary"), 256)


def index_root(index: DataFrame) -> DataFrame:
    """(archive_id, index_hash): the root of the tree over ``index_hash`` in the order of seq. A
    task holds one node's hashes at a time."""
    nodes = index.select("archive_id", F.col("seq").alias("at"), F.col("index_hash").alias("h"))
    for _ in range(LEVELS):
        told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        nodes = nodes.groupBy("archive_id", F.floor(F.col("at") / TREE).alias("_up")).agg(F.sha2(told.cast("binary"), 256).alias("h")).select("archive_id", F.col("_up").alias("at"), "h")
    return nodes.select("archive_id", F.col("h").alias("index_hash"))


def _written(lines: DataFrame, path: str, archive_id: str, fmt: str, year: int, before: dict, batch: str | None) -> None:
    spark = lines.sparkSession
    version = before["version"] + 1
    own = [F.col(c) for c in lines.columns if c in ("line_no", "raw", "end")]
    chunks = build_chunks(lines.select(F.lit(archive_id).alias("archive_id"), *own), fmt, year, start=0)
    moved = chunks.withColumn("seq", F.col("seq") + before["num_chunks"]).withColumn("chunk_id", F.col("chunk_id") + before["next_chunk"]).withColumn("offset", F.col("offset") + before["orig_size"])
    linked = chain.with_chain(moved, {archive_id: before["chain_hash"]} if before["chain_hash"] else None)
    target = f"archive_id={archive_id}/version={version}"
    parts = linked.drop("archive_id").withColumn("part", F.floor(F.col("seq") / PART_CHUNKS))
    parts.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/bodies/{target}")
    entries = _version(spark, path, "bodies", archive_id, version).select(*ENTRY, "part").withColumn("index_hash", entry_hash())
    entries.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index/{target}")
    new = _version(spark, path, "index", archive_id, version).agg(
        F.count(F.lit(1)).alias("n"), F.sum("orig_size").alias("size"), F.max_by("chunk_hash", "seq").alias("head"), F.max("chunk_id").alias("last")).first()
    root = index_root(_versions(spark, path, "index", archive_id, version)).first()
    row = (archive_id, version, fmt, new["head"] or before["chain_hash"], before["num_chunks"] + new["n"], before["orig_size"] + (new["size"] or 0),
           before["next_chunk"] if new["last"] is None else new["last"] + 1, root["index_hash"] if root else None, batch)
    spark.createDataFrame([row], ARCHIVE).coalesce(1).write.mode("append").parquet(f"{path}/archives")


def _read(spark: SparkSession, path: str, name: str, *folders: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}{x}" for x in folders])


def _version(spark: SparkSession, path: str, name: str, archive_id: str, version: int) -> DataFrame:
    return _read(spark, path, name, f"/archive_id={archive_id}/version={version}")


def _versions(spark: SparkSession, path: str, name: str, archive_id: str, version: int) -> DataFrame:
    """The rows of one archive up to a version; only their folders are listed."""
    return _read(spark, path, name, *[f"/archive_id={archive_id}/version={v}" for v in range(1, version + 1)])


def published(spark: SparkSession, path: str) -> DataFrame:
    """Every row ever published. A folder that is not there has none; any other failure is one."""
    try:
        return spark.read.schema(ARCHIVE).parquet(f"{path}/archives")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ARCHIVE)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every archive."""
    newest = Window.partitionBy("archive_id").orderBy(F.desc("version"))
    return published(spark, path).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _table(spark: SparkSession, path: str, name: str, archive_id: str | None) -> DataFrame:
    known = archives(spark, path)
    if archive_id is not None:
        row = known.where(F.col("archive_id") == archive_id).first()
        if row is None:
            raise ValueError(f"no archive {archive_id}")
        return _versions(spark, path, name, archive_id, row["version"]).drop("version")
    found = _read(spark, path, name, "")
    return found.join(known.select("archive_id", F.col("version").alias("_newest")), "archive_id").where("version <= _newest").drop("_newest", "version")


def index(spark: SparkSession, path: str, archive_id: str | None = None) -> DataFrame:
    """The index of published archives: their chunks without text."""
    return _table(spark, path, "index", archive_id)


def chunks(spark: SparkSession, path: str, archive_id: str | None = None) -> DataFrame:
    """The chunks of published archives."""
    return _table(spark, path, "bodies", archive_id)


def create(lines: DataFrame, path: str, archive_id: str, fmt: str | None = None, year: int = 2024, batch: str | None = None) -> None:
    """A new archive of ``lines`` (line_no, raw and, where lines may lack their end, ``end``); the
    format is found where none is given. An archive that is there is never replaced."""
    spark = lines.sparkSession
    if not published(spark, path).where(F.col("archive_id") == archive_id).isEmpty():
        raise FileExistsError(f"there is an archive {archive_id}")
    if fmt is None:
        found = detect.detect_format(lines.select(F.lit(archive_id).alias("archive_id"), "line_no", "raw")).first()
        fmt = found["format"] if found else "plaintext"
    _written(lines, path, archive_id, fmt, year, EMPTY, batch)


def append(lines: DataFrame, path: str, archive_id: str, year: int = 2024, batch: str | None = None) -> None:
    """More lines behind an archive's last; its format and chain go on in new chunks."""
    before = archives(lines.sparkSession, path).where(F.col("archive_id") == archive_id).first()
    if before is None:
        raise ValueError(f"no archive {archive_id}")
    _written(lines, path, archive_id, before["format"], year, before.asDict(), batch)


def candidates(spark: SparkSession, path: str, archive_id: str, find: Search) -> DataFrame:
    """The chunks of an archive that a search has to read: the index decides, and only the parts
    with a chunk that it leaves are opened, if there are at most ``NAMED_PARTS``."""
    left = find.prunes(index(spark, path, archive_id)).select("part").distinct().limit(NAMED_PARTS + 1).collect()
    every = chunks(spark, path, archive_id)
    some = every if len(left) > NAMED_PARTS else every.where(F.col("part").isin([r["part"] for r in left]))
    return find.survivors(some)


def search(spark: SparkSession, path: str, archive_id: str, find: Search) -> DataFrame:
    """(archive_id, chunk_id, raw): one row per matching line of a stored archive."""
    return find.lines(candidates(spark, path, archive_id, find))


def search_stats(spark: SparkSession, path: str, archive_id: str, find: Search) -> DataFrame:
    """One row as ``Search.stats`` has it: skips from the index alone, matches from what it leaves."""
    none = F.lit(None).cast("string")
    entries = index(spark, path, archive_id).select(F.lit(1).alias("_chunk"), find.reason().alias("reason"), F.lit(0).cast("long").alias("n"))
    texts = candidates(spark, path, archive_id, find).select(F.lit(0).alias("_chunk"), none.alias("reason"), find.matches().alias("n"))
    return find.counted(entries.union(texts))


def verify(spark: SparkSession, path: str) -> DataFrame:
    return chain.verify(chunks(spark, path), archives(spark, path))


def checked_index(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(archive_id, index_status, bad_entry): whether an index is the one that was written. A
    verdict of its own, beside that over the bytes."""
    entries = entries.withColumn("_now", entry_hash())
    bad = entries.groupBy("archive_id").agg(F.min(F.when(F.col("_now") != F.col("index_hash"), F.col("seq"))).alias("bad_entry"))
    root = index_root(entries.select("archive_id", "seq", F.col("_now").alias("index_hash"))).withColumnRenamed("index_hash", "_root")
    told = known.select("archive_id", "index_hash").join(bad, "archive_id", "left").join(root, "archive_id", "left")
    good = F.col("bad_entry").isNull() & F.col("_root").eqNullSafe(F.col("index_hash"))
    return told.select("archive_id", F.when(good, "VERIFIED").otherwise("TAMPERED").alias("index_status"), "bad_entry")


def verify_index(spark: SparkSession, path: str) -> DataFrame:
    return checked_index(index(spark, path), archives(spark, path))


def restored(found: DataFrame) -> DataFrame:
    """(archive_id, raw): chunks whose bodies, in this order, are the archived bytes."""
    return found.orderBy("archive_id", "seq").select("archive_id", F.col("raw").cast("binary").alias("raw"))


def restore(found: DataFrame, path: str) -> int:
    """Writes an archive's bytes to a local file, chunk by chunk; returns how many."""
    n = 0
    with open(path, "wb") as out:
        for row in restored(found).toLocalIterator():
            n += out.write(row["raw"])
    return n


def stats(found: DataFrame) -> DataFrame:
    """Sizes by archive: chunks, lines, bytes, and index bytes in percent of them."""
    return found.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("n_lines").cast("long").alias("lines"), F.sum("orig_size").cast("long").alias("bytes")
    ).withColumn("index_percent", F.round(F.col("chunks") * 1600 * 100 / F.nullif("bytes", F.lit(0)), 4))


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, bytes, stored_bytes, ratio): what an archive takes on disk, bodies and index,
    from the lengths of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    parts = [files.load(f"{path}/{table}").select("path", "length") for table in ("bodies", "index")]
    archive, version = (F.regexp_extract("path", f"/{key}=([^/]+)/", 1) for key in ("archive_id", "version"))
    own = parts[0].union(parts[1]).groupBy(archive.alias("archive_id"), version.cast("int").alias("_version")).agg(F.sum("length").alias("length"))
    known = archives(spark, path).select("archive_id", "version", F.col("orig_size").alias("bytes"))
    found = own.join(known, "archive_id").where("_version <= version").groupBy("archive_id", "bytes").agg(F.sum("length").alias("stored_bytes"))
    return found.withColumn("ratio", F.round(F.col("bytes") / F.col("stored_bytes"), 3))
