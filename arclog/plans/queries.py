"""The registered queries of the archive engine, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclog.functions import text as t
from arclog.functions import times
from arclog.operators import archive, chain, detect, export, index, retention
from arclog.operators.chunking import with_chunks
from arclog.operators.search import Search
from arclog.sources import corpus, logz, objects, policy
from arclog.streaming import ingest

YEAR = corpus.SYSLOG_YEAR
NOW = 1_735_689_600  # 2025-01-01T00:00:00Z, so that decisions do not change from day to day
DAY_FROM, DAY_TO = "2024-01-03", "2024-01-05"

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark, sf_dir):
    return corpus.json_log(spark, sf_dir)


def _placed(spark, sf_dir):
    return with_chunks(corpus.json_log(spark, sf_dir))


def _chunks(spark, sf_dir):
    return index.build_chunks(corpus.json_log(spark, sf_dir), "json")


def _bodies(spark, sf_dir):
    """Chunks for queries that use neither filter."""
    return index.build_chunks(corpus.json_log(spark, sf_dir), "json", filters=False)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares with its executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Archives that this process has stored, by session and state of the table that they are made of.
_STORED: dict[tuple, str] = {}

LOGS = {"json_log": (corpus.json_log, "events", "json"), "plain_log": (corpus.plain_log, "documents", "plaintext")}


def stored(spark: SparkSession, sf_dir: str, name: str = "json_log") -> str:
    """The folder of a stored archive of a log, the same for all queries of a session while the
    table's files are the same. Searches, exports and verdicts are about archives that are there."""
    log, table, fmt = LOGS[name]
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{table}.parquet").select("path", "modificationTime", "length")
    key = (spark.sparkContext.applicationId, name, *sorted(map(tuple, files.collect())))
    if key not in _STORED:
        path = scratch(spark, "archive")
        archive.create(log(spark, sf_dir).select("line_no", "raw"), path, name, fmt, YEAR)
        _STORED[key] = path
    return _STORED[key]


def _stored_chunks(spark, sf_dir, name="json_log"):
    return archive.chunks(spark, stored(spark, sf_dir, name), name)


def _lines_of(find: Search, name: str = "json_log") -> Query:
    return lambda spark, sf_dir: archive.search(spark, stored(spark, sf_dir, name), name, find).select("chunk_id", "raw")


def _hashed(name: str) -> Query:
    def run(spark, sf_dir):
        words = corpus.chat_log(spark, sf_dir).select(F.explode(t.tokens(F.col("raw"))).alias("token")).distinct()
        return words.select("token", getattr(t, name)(F.col("token")).alias("hash"))

    return run


def tokenize(spark, sf_dir):
    return _raw(spark, sf_dir).select("line_no", F.posexplode(t.tokens(F.col("raw"))).alias("place", "token"))


def chunk_sizes(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("lines"), F.min("offset").alias("first_byte"), F.sum(F.octet_length("raw") + 1).cast("long").alias("bytes"))


def chunk_time_zone(spark, sf_dir):
    return index.time_zones(_placed(spark, sf_dir), "json").select("chunk_id", "min_ts", "max_ts")


def chunk_time_first_last(spark, sf_dir):
    return index.first_last_times(_placed(spark, sf_dir), "json").select("chunk_id", "first_ts", "last_ts")


def bloom_bits(spark, sf_dir):
    return index.token_positions(_placed(spark, sf_dir)).select("chunk_id", "bit").distinct()


def field_bloom_bits(spark, sf_dir):
    return index.field_positions(_placed(spark, sf_dir)).select("chunk_id", "bit").distinct()


def bloom_fill(spark, sf_dir):
    """Bits set in the filters themselves."""
    set_bits = lambda c: F.bitmap_count(F.col(c)).cast("long")
    return _chunks(spark, sf_dir).select("chunk_id", set_bits("bloom").alias("text_bits"), set_bits("field_bloom").alias("field_bits"))


def _formats(find) -> Query:
    def run(spark, sf_dir):
        logs = [corpus.json_log, corpus.syslog_log, corpus.plain_log, corpus.chat_log]
        parts = [find(log(spark, sf_dir)) for log in logs]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    return run


def iso_epoch(spark, sf_dir):
    return _raw(spark, sf_dir).select("line_no", times.iso_epoch(t.json_value(F.col("raw"), "timestamp")).alias("epoch"))


def numeric_epoch(spark, sf_dir):
    value = F.concat(F.col("o_orderkey").cast("string"), F.lit("00000"), F.when(F.col("o_orderkey") % 2 == 0, ".75").otherwise(""))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value.alias("value"))
    return rows.select("o_orderkey", times.numeric_epoch(F.col("value")).alias("epoch"))


def syslog_epoch(spark, sf_dir):
    return corpus.syslog_log(spark, sf_dir).select("line_no", times.syslog_epoch(F.col("raw"), YEAR).alias("epoch"))


def line_epoch(spark, sf_dir):
    """Plain text in which lines of both other formats stand."""
    both = corpus.json_log(spark, sf_dir).union(corpus.syslog_log(spark, sf_dir))
    return both.select("archive_id", "line_no", times.line_epoch(F.col("raw"), F.lit("plaintext"), YEAR).alias("epoch"))


def json_fields(spark, sf_dir):
    line = F.col("raw")
    return _raw(spark, sf_dir).select("line_no", *[t.first_field(line, name).alias(name) for name in t.ALIASES])


def search_stats(spark, sf_dir):
    find = Search("error", frm=DAY_FROM, to=DAY_TO, user="u7", mode="reference")
    return archive.search_stats(spark, stored(spark, sf_dir), "json_log", find)


def export_records(spark, sf_dir):
    return export.export_records(_stored_chunks(spark, sf_dir))


def export_plain(spark, sf_dir):
    return export.export_records(_stored_chunks(spark, sf_dir, "plain_log"), fmt="plaintext")


def export_time_window(spark, sf_dir):
    return export.export_records(_stored_chunks(spark, sf_dir), DAY_FROM, DAY_TO, mode="reference")


def export_time_window_exact(spark, sf_dir):
    return export.export_records(_stored_chunks(spark, sf_dir), DAY_FROM, DAY_TO)


def export_stats(spark, sf_dir):
    return export.export_stats(_stored_chunks(spark, sf_dir), DAY_FROM, DAY_TO)


def csv_quoted(spark, sf_dir):
    return _raw(spark, sf_dir).select("line_no", t.csv_quoted(F.col("raw")).alias("cell"))


def hash_chain(spark, sf_dir):
    """The chain built anew over chunks that are made on the way."""
    return chain.with_chain(_bodies(spark, sf_dir).select("archive_id", "seq", "chunk_id", "raw")).select("seq", "chunk_hash")


def _verdict(tamper: Callable[[DataFrame], DataFrame] = lambda c: c, footer: Callable[[DataFrame], DataFrame] = lambda a: a) -> Query:
    def run(spark, sf_dir):
        path = stored(spark, sf_dir)
        return chain.verify(tamper(archive.chunks(spark, path)), footer(archive.archives(spark, path)))

    return run


def _index_verdict(tamper: Callable[[DataFrame], DataFrame] = lambda c: c) -> Query:
    def run(spark, sf_dir):
        path = stored(spark, sf_dir)
        return archive.checked_index(tamper(archive.index(spark, path)), archive.archives(spark, path))

    return run


def restore_digest(spark, sf_dir):
    """Digests of a stored archive's bytes as they are restored, by blocks of 16 chunks, in order."""
    bytes_ = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex(F.col("raw").cast("binary")).alias("x")))), lambda x: x["x"]), ""))
    blocks = _stored_chunks(spark, sf_dir).groupBy(F.floor(F.col("seq") / 16).alias("block"))
    return blocks.agg(F.sha2(bytes_, 256).alias("digest"), F.sum("orig_size").alias("bytes"))


def _halves(spark, sf_dir):
    """The log in two archives' worth of chunks, the second behind the first."""
    lines = corpus.json_log(spark, sf_dir)
    old = index.build_chunks(lines.where("line_no % 1000 < 500"), "json", filters=False).select("archive_id", "seq", "raw")
    new = index.build_chunks(lines.where("line_no % 1000 >= 500"), "json", filters=False).select("archive_id", "seq", "raw")
    count = old.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n"))
    return old.unionByName(new.join(F.broadcast(count), "archive_id").withColumn("seq", F.col("seq") + F.col("n")).drop("n"))


def append_chain(spark, sf_dir):
    return chain.with_chain(_halves(spark, sf_dir)).select("seq", "chunk_hash")


def append_union(spark, sf_dir):
    return _halves(spark, sf_dir).select("seq", F.octet_length("raw").cast("long").alias("bytes"))


def archive_stats(spark, sf_dir):
    return archive.stats(archive.index(spark, stored(spark, sf_dir), "json_log"))


def archive_create(spark, sf_dir):
    """A new archive, from lines to the published row; its sizes by its index."""
    path = scratch(spark, "created")
    archive.create(corpus.json_log(spark, sf_dir).select("line_no", "raw"), path, "json_log", None, YEAR)
    return archive.stats(archive.index(spark, path, "json_log"))


def archive_append(spark, sf_dir):
    """Half a log stored, the other half appended, and the chain as the index has it."""
    path, lines = scratch(spark, "appended"), corpus.json_log(spark, sf_dir).select("line_no", "raw")
    archive.create(lines.where("line_no % 1000 < 500"), path, "json_log", "json", YEAR)
    archive.append(lines.where("line_no % 1000 >= 500"), path, "json_log", YEAR)
    return archive.index(spark, path, "json_log").select("seq", "chunk_hash")


def archive_stream(spark, sf_dir):
    """Syslog lines that arrive as files, one by one without a line end at the last line."""
    source, path = scratch(spark, "arrived"), scratch(spark, "streamed")
    corpus.syslog_log(spark, sf_dir).repartition(3, "line_no").sortWithinPartitions("line_no").select("raw").write.text(source)
    query = ingest.follow(spark, source, path, "syslog_log", scratch(spark, "state"), "syslog", YEAR)
    query.awaitTermination()
    return archive.search(spark, path, "syslog_log", Search(fmt="syslog", year=YEAR)).select("raw")


def _read_back(write, read) -> Query:
    """What an export's files hold."""
    def run(spark, sf_dir):
        path = scratch(spark, "export")
        write(export_records(spark, sf_dir), path)
        return read(spark, path).select(*t.EXPORT_COLUMNS)

    return run


def _csv(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)


def utf8_replaced(spark, sf_dir):
    """Lines with a byte that is no UTF-8, archived, found and shown."""
    broken = F.concat(F.col("raw").cast("binary"), F.lit(bytearray(b"\xff"))).cast("string")
    lines = corpus.syslog_log(spark, sf_dir).withColumn("raw", broken)
    return Search(mode="reference", fmt="syslog", year=YEAR).run(index.build_chunks(lines, "syslog", YEAR)).select("raw")


POLICY = "streams:\n" + "".join(f"  - name: {n}\n    pattern: '{p}'   # kept\n    retention_days: {d}\n    lock: {str(k).lower()}\n" for n, p, d, k in corpus.STREAMS)


def policy_streams(spark, sf_dir):
    """The streams of a policy's text and what is listed for each."""
    told = policy.parse(POLICY)
    prefixes = F.create_map(*[F.lit(x) for s in told for x in (s.name, "/".join(policy.list_prefix(s.pattern)))])
    return policy.as_table(spark, told).withColumn("listed", F.element_at(prefixes, F.col("name")))


def retention_actions(spark, sf_dir):
    """How many objects a dry run would lock, delete and keep."""
    counts = objects.apply(retention_plan(spark, sf_dir), None)
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(n).cast("long").alias("n")) for a, n in sorted(counts.items())])
    return spark.range(1).select(F.inline(rows))


def url_encoded(spark, sf_dir):
    key = F.concat("key", F.lit(" é+~*%/"), "bucket")
    return corpus.objects(spark, sf_dir).select(key.alias("key"), t.url_encoded(key).alias("encoded"))


def retention_plan(spark, sf_dir):
    return retention.plan(corpus.objects(spark, sf_dir), corpus.streams(spark), NOW)


def lock_status(spark, sf_dir):
    return retention.lock_status(corpus.objects(spark, sf_dir), NOW)


def s3_url_parse(spark, sf_dir):
    rows = corpus.objects(spark, sf_dir).withColumn("url", F.concat(F.lit("s3://"), "bucket", F.lit("//"), "key"))
    parts = t.s3_parts(F.col("url"))
    return rows.select("url", parts["bucket"].alias("bucket"), parts["key"].alias("key"))


def glob_match(spark, sf_dir):
    rules = corpus.streams(spark).select("name", t.glob_regex(F.regexp_extract("pattern", "^s3://[^/]+/+(.+)$", 1)).alias("regex"))
    return corpus.objects(spark, sf_dir).select("key").join(F.broadcast(rules), F.expr("key RLIKE regex")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _exchanged(spark: SparkSession, sf_dir: str):
    """The JSON log written as one exchange file in a shared folder; a reader of it."""
    path = scratch(spark, "exchange") + ".logz"
    spark.dataSource.register(logz.LogzSource)
    corpus.json_log(spark, sf_dir).select("line_no", "raw").write.format("logz").mode("append").option("format", "json").save(path)
    return lambda **options: spark.read.format("logz").options(**options).load(path)


def logz_roundtrip(spark, sf_dir):
    """Byte chunks read back, with the chain link of each as stored."""
    return _exchanged(spark, sf_dir)().select("chunk_id", "orig_size", "min_ts", "max_ts", "chunk_hash", F.sha2("raw", 256).alias("digest"))


def logz_pruned(spark, sf_dir):
    """Byte chunks that a search reads, by the file's own filters and times."""
    read = _exchanged(spark, sf_dir)(**{"query": "u7", "from": DAY_FROM, "to": DAY_TO})
    return read.select("chunk_id", "orig_size")


def queries() -> dict[str, Query]:
    found = [
        tokenize, chunk_sizes, chunk_time_zone, chunk_time_first_last, bloom_bits, field_bloom_bits, bloom_fill, iso_epoch, numeric_epoch,
        syslog_epoch, line_epoch, json_fields, search_stats, export_records, export_plain, export_time_window, export_time_window_exact,
        export_stats, csv_quoted, hash_chain, restore_digest, append_chain, append_union, archive_stats, retention_plan, lock_status,
        s3_url_parse, glob_match, logz_roundtrip, logz_pruned, archive_create, archive_append, archive_stream, utf8_replaced,
        policy_streams, retention_actions, url_encoded,
    ]
    flipped = lambda c: c.withColumn("raw", F.when(F.col("seq") == 1, F.concat(F.lit("#"), F.substring("raw", 2, 1 << 30))).otherwise(F.col("raw")))
    zeroed = lambda c: c.withColumn("chunk_hash", F.when(F.col("seq") == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("chunk_hash")))
    return {f.__name__: f for f in found} | {
        "djb2": _hashed("djb2"), "fnv1a": _hashed("fnv1a"), "sdbm": _hashed("sdbm"),
        "detect_format": _formats(detect.detect_format), "detect_format_quick": _formats(detect.detect_format_quick),
        "search_text_exact": _lines_of(Search('"user": "u7", "ip')),
        "search_text_reference": _lines_of(Search("erro", mode="reference")),
        "search_subtoken_exact": _lines_of(Search("erro")),
        "search_plain_exact": _lines_of(Search("the ", fmt="plaintext"), "plain_log"),
        "search_time_chunk": _lines_of(Search(frm=DAY_FROM, to=DAY_TO, mode="reference")),
        "search_time_exact": _lines_of(Search(frm=DAY_FROM, to="2024-01-04T12:30:00")),
        "search_field_chunk": _lines_of(Search(user="u7", mode="reference")),
        "search_field_exact": _lines_of(Search(user="u7", action="click")),
        "search_combined": _lines_of(Search("event 1", frm=DAY_FROM, to=DAY_TO, user="u7", level="ERROR")),
        "search_empty_query": _lines_of(Search(mode="reference")),
        "verify_clean": _verdict(), "verify_tampered": _verdict(flipped), "verify_zeroed_hash": _verdict(zeroed),
        "verify_index": _index_verdict(),
        "verify_index_tampered": _index_verdict(lambda c: c.withColumn("bloom", F.when(F.col("seq") == 1, F.lit(bytearray(1024))).otherwise(F.col("bloom")))),
        "export_csv": _read_back(export.write_csv, _csv),
        "export_jsonl": _read_back(export.write_jsonl, lambda spark, path: spark.read.schema(", ".join(f"`{c}` string" for c in t.EXPORT_COLUMNS)).json(path)),
        "verify_footer_mismatch": _verdict(footer=lambda a: a.withColumn("num_chunks", F.col("num_chunks") + 1)),
    }
