"""Log lines made of tables: (archive_id, line_no, raw)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYSLOG_YEAR = 2024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per event."""
    return _table(spark, sf_dir, "events").select(
        F.lit("json_log").alias("archive_id"), F.col("event_id").alias("line_no"),
        F.concat(
            F.lit('{"timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z", "level": "'),
            F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit('", "user": "u'), F.col("user_id").cast("string"),
            F.lit('", "ip": "10.0.'), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"),
            F.lit('", "action": "'), F.col("event_type"), F.lit('", "message": "event '), F.col("event_id").cast("string"),
            F.lit('", "props": '), F.col("props"), F.lit("}"),
        ).alias("raw"))


def syslog_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One syslog line per event."""
    return _table(spark, sf_dir, "events").select(
        F.lit("syslog_log").alias("archive_id"), F.col("event_id").alias("line_no"),
        F.concat(
            F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 8).cast("string"),
            F.lit(" app: "), F.col("event_type"), F.lit(" id="), F.col("event_id").cast("string"),
        ).alias("raw"))


def plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents, numbered by document and place in it."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return lines.select(F.lit("plain_log").alias("archive_id"), (F.col("doc_id") * 1_000_000 + F.col("at")).alias("line_no"), "raw")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per turn of all conversations; line ends within are blanks."""
    return _table(spark, sf_dir, "conversations").select(
        F.lit("chat_log").alias("archive_id"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("line_no"),
        F.regexp_replace(F.concat("role", F.lit(": "), "text"), "\n", " ").alias("raw"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a store, made of orders: (bucket, key, last_modified, lock_mode, lock_until)."""
    key = F.col("o_orderkey")
    name = F.concat(
        F.when(key % 3 == 0, "audit/").when(key % 3 == 1, "app/").otherwise("app/old/"),
        F.col("o_orderkey").cast("string"), F.when(key % 2 == 0, ".logz").otherwise(".log"))
    return _table(spark, sf_dir, "orders").select(
        F.when(key % 5 == 0, "other").otherwise("logs").alias("bucket"), name.alias("key"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"),
        F.when(key % 7 == 0, "COMPLIANCE").when(key % 7 == 1, "GOVERNANCE").otherwise("").alias("lock_mode"),
        F.when(key % 7 == 0, F.concat(F.lit("1"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-01-01T00:00:00")))
        .when(key % 7 == 1, F.lit("2999-01-01T00:00:00")).otherwise(F.lit("")).alias("lock_until"))


#: (name, pattern, retention_days, lock)
STREAMS = (
    ("audit", "s3://logs/audit/*.logz", 2555, True),
    ("app", "s3://logs/app/*.logz", 9000, False),
    ("all", "s3://other/*/*", 30, True),
    ("new", "s3://logs/app/*.log", 20000, True),
)


def streams(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"), F.lit(d).cast("long").alias("retention_days"), F.lit(k).alias("lock")) for n, p, d, k in STREAMS])
    return spark.range(1).select(F.inline(rows))
