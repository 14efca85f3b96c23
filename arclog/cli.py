"""Commands over archives: compress, append, search, decompress, verify, export, retention.

    python -m arclog.cli compress app.log /archives --id app
    python -m arclog.cli search /archives "connection reset" --id app --from 2025-01-01

Exit codes: 0 done, 1 an error or a chain that does not hold, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclog.operators import archive, export, retention
from arclog.operators.search import Search
from arclog.sources import objects, policy


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arclog")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("compress", "append"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("archive")
        p.add_argument("--id", required=True)
        p.add_argument("--format", choices=["json", "syslog", "plaintext"])
        p.add_argument("--year", type=int, default=2024)
    for name in ("search", "export"):
        p = sub.add_parser(name)
        p.add_argument("archive")
        p.add_argument("--id", required=True)
        p.add_argument("--from", dest="frm")
        p.add_argument("--to")
        p.add_argument("--mode", choices=["exact", "reference"], default="exact")
        if name == "search":
            p.add_argument("query", nargs="?", default="")
            for field in ("user", "ip", "action", "level"):
                p.add_argument(f"--{field}")
        else:
            p.add_argument("output")
            p.add_argument("--format", choices=["csv", "json"], default="csv")
    p = sub.add_parser("decompress")
    p.add_argument("archive")
    p.add_argument("--id", required=True)
    p.add_argument("--output", required=True)
    p = sub.add_parser("verify")
    p.add_argument("archive")
    p = sub.add_parser("verify-lock")
    p.add_argument("objects", help="Parquet table of objects")
    p.add_argument("--now", type=int, default=0)
    p = sub.add_parser("retention")
    p.add_argument("config")
    p.add_argument("objects", help="Parquet table of objects, or a folder to list with --list")
    p.add_argument("--list", action="store_true")
    p.add_argument("--now", type=int, default=0)
    return top


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw, end) of a text file: numbered by block of the file, then by place in it.
    The file's length tells whether its last line has an end."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    told = text.agg(F.sum(F.octet_length("raw").cast("long") + 1).alias("n"), F.max("line_no").alias("last")).first()
    whole = told["n"] is None or told["n"] == length
    return text.withColumn("end", F.lit(True) if whole else F.col("line_no") != told["last"])


def print_all(df: DataFrame) -> None:
    """Every row, tab-separated below the names of the columns; one partition at a time comes
    to the driver."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command in ("compress", "append"):
        lines = lines_of(spark, args.input)
        if args.command == "compress":
            archive.create(lines, args.archive, args.id, args.format, args.year)
        else:
            archive.append(lines, args.archive, args.id, args.year)
        archive.stats(archive.index(spark, args.archive, args.id)).show(truncate=False)
        archive.stored_sizes(spark, args.archive).where(F.col("archive_id") == args.id).show(truncate=False)
    elif args.command in ("search", "export"):
        found = archive.chunks(spark, args.archive, args.id)
        fmt = archive.archives(spark, args.archive).where(F.col("archive_id") == args.id).first()["format"]
        if args.command == "search":
            search = Search(args.query, args.frm, args.to, args.user, args.ip, args.action, args.level, args.mode, fmt)
            for row in archive.search(spark, args.archive, args.id, search).toLocalIterator():
                print(row["raw"])
            print(search.stats(found).first().asDict(), file=sys.stderr)
        else:
            records = export.export_records(found, args.frm, args.to, args.mode, fmt)
            (export.write_csv if args.format == "csv" else export.write_jsonl)(records, args.output)
    elif args.command == "decompress":
        print(archive.restore(archive.chunks(spark, args.archive, args.id), args.output), "bytes", file=sys.stderr)
    elif args.command == "verify":
        verdicts = archive.verify(spark, args.archive).collect()
        entries = {row["archive_id"]: row["index_status"] for row in archive.verify_index(spark, args.archive).collect()}
        for row in verdicts:
            print(row.asDict() | {"index_status": entries[row["archive_id"]]})
        return int(any(row["status"] != "VERIFIED" for row in verdicts) or any(x != "VERIFIED" for x in entries.values()))
    elif args.command == "verify-lock":
        print_all(retention.lock_status(spark.read.parquet(args.objects), args.now or int(time.time())))
    else:
        with open(args.config) as f:
            streams = policy.as_table(spark, policy.parse(f.read()))
        there = objects.listed(spark, args.objects) if args.list else spark.read.parquet(args.objects)
        print_all(retention.plan(there, streams, args.now or int(time.time())))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("arclog").getOrCreate()
    try:
        return run(spark, args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
