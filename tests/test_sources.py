"""The exchange format, policies, retention, streaming and the commands."""

import json
import os

import pytest
from pyspark.sql import functions as F

from arclog import cli
from arclog.operators import archive, retention
from arclog.sources import logz, objects, policy
from arclog.streaming import ingest

LINES = [json.dumps({"timestamp": f"2025-01-{1 + i // 100:02d}T00:00:00Z", "user": f"u{i // 200}", "message": f"event {i}", "pad": "z" * 500}) for i in range(1000)]


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logz") / "a.logz")
    logz.write_file(path, "\n".join(LINES).encode(), "json")
    return path


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(logz.LogzSource)
    return lambda path, **options: spark.read.format("logz").options(**options).load(path)


def test_layout(file):
    size = os.path.getsize(file)
    with open(file, "rb") as f:
        data = f.read()
    assert data[:4] == b"LOGZ" and size < len("\n".join(LINES)) and logz.ENTRY.size == 1600 and logz.FOOTER.size == 44
    index = logz.Index.of(file)
    assert index.chain_hash == index.entries[-1][4] and all(any(e[3]) and any(e[7]) for e in index.entries)


def test_round_trip(source, file):
    rows = source(file).orderBy("chunk_id").collect()
    assert b"".join(bytes(r["raw"]) for r in rows).decode() == "\n".join(LINES) and len(rows) > 5


def test_pruned_reads(source, file):
    every = source(file).count()
    assert 0 < source(file, **{"from": "2025-01-05", "to": "2025-01-05"}).count() < every
    assert 0 < source(file, user="u3").count() < every
    assert source(file, query="NOT_THERE").count() == 0
    kept, skipped = logz.surviving(logz.Index.of(file), {"query": "event", "user": "u3"})
    assert len(kept) + sum(skipped.values()) == every and skipped["field"] > 0


def test_written_by_spark(spark, source, tmp_path):
    path = str(tmp_path / "b.logz")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_no long, raw string").repartition(3)
    df.write.format("logz").mode("append").option("format", "json").save(path)
    assert b"".join(bytes(r["raw"]) for r in source(path).orderBy("chunk_id").collect()).decode() == "\n".join(LINES) + "\n"


def test_damaged_header(source, tmp_path):
    path = tmp_path / "c.logz"
    path.write_bytes(b"NOPE" + bytes(100))
    with pytest.raises(ValueError):
        logz.Index.of(str(path))


POLICY = """
# three streams
streams:
  - name: admin   # kept long
    pattern: s3://logs/admin-*.logz
    retention_days: 2555
    lock: true
  - name: "debug"
    pattern: 's3://logs/debug/*.logz'
    retention_days: 90
    lock: false
    owner: nobody
"""


def test_policy():
    admin, debug = policy.parse(POLICY)
    assert admin == policy.Stream("admin", "s3://logs/admin-*.logz", 2555, True)
    assert debug == policy.Stream("debug", "s3://logs/debug/*.logz", 90, False)
    assert policy.list_prefix(debug.pattern) == ("logs", "debug/")
    for bad in ("", "streams:\n", "streams:\n  - name: x\n    pattern: s3://a/b\n", "streams:\n  - name: x\n    pattern: /a\n    retention_days: 3\n"):
        with pytest.raises(ValueError):
            policy.parse(bad)


def test_decisions(spark):
    now = 1_735_689_600
    day = lambda n: f"{(1_735_689_600 - n * 86400)}"
    rows = [
        ("admin-new.logz", 10, "", ""), ("admin-old.logz", 3000, "", ""), ("admin-locked.logz", 3000, "COMPLIANCE", "2030-01-01T00:00:00Z"),
        ("admin-odd.logz", 10, "COMPLIANCE", "soon"), ("debug/a.logz", 91, "", ""), ("debug/b.logz", 1, "", ""),
        ("debug/deep/c.logz", 91, "", ""), ("debug/d.logz", 91, "GOVERNANCE", "2025-01-01T12:00:00Z"), ("debug/axlogz", 91, "", ""),
    ]
    table = spark.createDataFrame([("logs", k, int(day(n)), m, u) for k, n, m, u in rows], "bucket string, key string, s long, lock_mode string, lock_until string")
    table = table.withColumn("last_modified", F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss"))
    plan = retention.plan(table, policy.as_table(spark, policy.parse(POLICY)), now)
    assert {r["key"]: r["action"] for r in plan.collect()} == {
        "admin-new.logz": "LOCK", "admin-old.logz": "DELETE", "admin-locked.logz": "OK_LOCKED", "admin-odd.logz": "UNKNOWN_LOCK",
        "debug/a.logz": "DELETE", "debug/b.logz": "OK_UNLOCKED", "debug/d.logz": "DELETE",
    }
    status = {r["key"]: r["status"] for r in retention.lock_status(table, now).collect()}
    assert status["admin-locked.logz"] == "LOCKED — COMPLIANCE mode, retain until 2030-01-01"
    assert status["admin-odd.logz"] == "UNKNOWN_LOCK" and status["debug/d.logz"] == "NOT LOCKED"
    done = []

    class Store:
        def set_retention(self, bucket, key, until):
            done.append(("lock", key))

        def delete(self, bucket, key):
            done.append(("delete", key))

    assert objects.apply(plan, Store())["DELETE"] == 3 and not done
    objects.apply(plan, Store(), dry_run=False)
    assert sorted(done) == [("delete", "admin-old.logz"), ("delete", "debug/a.logz"), ("delete", "debug/d.logz"), ("lock", "admin-new.logz")]


def test_listing(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.logz").write_bytes(b"1")
    (tmp_path / "logs" / "b.txt").write_bytes(b"1")
    rows = objects.listed(spark, str(tmp_path / "logs"), "*.logz").collect()
    assert [r["key"].rpartition("/")[2] for r in rows] == ["a.logz"] and rows[0]["last_modified"]


def test_stream(spark, tmp_path):
    source, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    source.mkdir()
    (source / "one.log").write_text("\n".join(LINES[:300]) + "\n")
    ingest.follow(spark, str(source), store, "s", state).awaitTermination()
    (source / "two.log").write_text("\n".join(LINES[300:]) + "\n")
    ingest.follow(spark, str(source), store, "s", state).awaitTermination()
    archive.restore(archive.chunks(spark, store, "s"), str(tmp_path / "back"))
    assert (tmp_path / "back").read_text() == "\n".join(LINES) + "\n"
    assert archive.verify(spark, store).first()["status"] == "VERIFIED"


def test_commands(spark, tmp_path, capsys):
    log, store = tmp_path / "in.log", str(tmp_path / "store")
    log.write_text("\n".join(LINES) + "\n")
    run = lambda *args: cli.run(spark, cli.parser().parse_args(list(args)))
    assert run("compress", str(log), store, "--id", "x") == 0
    assert run("append", str(log), store, "--id", "x") == 0
    assert run("verify", store) == 0
    capsys.readouterr()
    assert run("search", store, "\"event 7\"", "--id", "x") == 0
    assert capsys.readouterr().out.splitlines() == [LINES[7]] * 2
    assert run("export", store, str(tmp_path / "out"), "--id", "x", "--format", "json") == 0
    assert run("decompress", store, "--id", "x", "--output", str(tmp_path / "back")) == 0
    assert (tmp_path / "back").read_text() == log.read_text() * 2


def test_commands_print_every_object(spark, tmp_path, capsys):
    keys = [f"debug/{i}.logz" for i in range(1200)]
    rows = [("logs", k, "2024-01-01T00:00:00Z", None, None) for k in keys]
    spark.createDataFrame(rows, "bucket string, key string, last_modified string, lock_mode string, lock_until string").write.parquet(str(tmp_path / "objects"))
    (tmp_path / "policy.yaml").write_text(POLICY)
    for args in (["verify-lock", str(tmp_path / "objects")], ["retention", str(tmp_path / "policy.yaml"), str(tmp_path / "objects")]):
        assert cli.run(spark, cli.parser().parse_args([*args, "--now", "1735689600"])) == 0
        printed = capsys.readouterr().out
        assert len(printed.splitlines()) == 1201 and all(k in printed for k in keys)


def test_files_without_a_last_line_end_and_batches_run_again(spark, tmp_path):
    source, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    source.mkdir()
    data = [b"one\n\ntwo \xff\nlast", b"\xc3\xa9\n"]
    for i, x in enumerate(data):
        (source / f"{i}.log").write_bytes(x)
        ingest.follow(spark, str(source), store, "s", state, "plaintext").awaitTermination()
        os.utime(source / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    # a crash after an archive was published and before the stream noted its batch
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{state}/commits/{name}")
    ingest.follow(spark, str(source), store, "s", state).awaitTermination()
    archive.restore(archive.chunks(spark, store, "s"), str(tmp_path / "back"))
    assert (tmp_path / "back").read_bytes() == b"".join(data)
    assert archive.verify(spark, store).first()["status"] == "VERIFIED"


def test_file_store(spark, tmp_path):
    store = objects.FileStore(str(tmp_path / "s"), "2025-01-01T00:00:00Z")
    store.put("logs", "a/b c*.logz", b"1", "COMPLIANCE", "2030-01-01T00:00:00Z")
    store.put("logs", "free.logz", b"2")
    store.put("logs", "past.logz", b"3", "GOVERNANCE", "2020-01-01T00:00:00Z")
    assert store.check_lock("logs", "a/b c*.logz") == ("COMPLIANCE", "2030-01-01T00:00:00Z") and store.check_lock("logs", "free.logz") == ("", "")
    for refused in (lambda: store.delete("logs", "a/b c*.logz"), lambda: store.put("logs", "a/b c*.logz", b"x"), lambda: store.set_retention("logs", "a/b c*.logz", "2026-01-01T00:00:00Z")):
        with pytest.raises(PermissionError):
            refused()
    with pytest.raises(FileNotFoundError):
        store.check_lock("logs", "nothing")
    rows = {r["key"]: r["status"] for r in retention.lock_status(store.table(spark), 1_735_689_600).collect()}
    assert rows == {"a/b c*.logz": "LOCKED — COMPLIANCE mode, retain until 2030-01-01", "free.logz": "NOT LOCKED", "past.logz": "NOT LOCKED"}
    text = "streams:\n  - name: x\n    pattern: s3://logs/*.logz\n    retention_days: 1\n    lock: true\n"
    plan = retention.plan(store.table(spark), policy.as_table(spark, policy.parse(text)), 1_735_689_600)
    done = objects.apply(plan, store, "2031-01-01T00:00:00Z", dry_run=False)
    assert done == {"LOCK": 2} and store.check_lock("logs", "free.logz")[1] == store.check_lock("logs", "past.logz")[1] == "2031-01-01T00:00:00Z"


def test_written_line_by_line(tmp_path):
    whole, parts = tmp_path / "whole.logz", tmp_path / "parts.logz"
    data = "\n".join(LINES).encode()
    logz.write_file(str(whole), data, "json")
    logz.write_file(str(parts), logz._slices(data[i : i + 777] for i in range(0, len(data), 777)), "json")
    assert whole.read_bytes() == parts.read_bytes()


def test_stored_archives_follow_their_table(spark, tmp_path):
    from arclog.plans import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(50).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    one = queries.stored(spark, str(tmp_path))
    assert queries.stored(spark, str(tmp_path)) == one
    events.limit(60).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    two = queries.stored(spark, str(tmp_path))
    assert two != one and archive.index(spark, two, "json_log").agg(F.sum("n_lines")).first()[0] == 60
