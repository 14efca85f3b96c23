"""Archives end to end: layout, search, windows, fields, chain, export, restore, append."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arclog.functions import bloom
from arclog.functions import text as t
from arclog.operators import archive, chain, detect, export, index
from arclog.operators.chunking import byte_chunks, with_chunks
from arclog.operators.search import Search, search


def frame(spark, lines, archive_id="a"):
    return spark.createDataFrame([(archive_id, i, x) for i, x in enumerate(lines)], "archive_id string, line_no long, raw string")


def timed_lines():
    """Three days; hours run over and over, so a day's lines are not in order."""
    return [
        json.dumps({"timestamp": f"2025-01-{15 + day}T{i % 24:02d}:30:00Z", "day": day, "marker": f"DAY{day}MARKER", "payload": "x" * 800})
        for day in range(3) for i in range(150)
    ]


def field_lines():
    groups = [("admin", "192.168.1.1", "login", "ADMIN_LOGIN"), ("alice", "10.0.0.1", "logout", "ALICE_LOGOUT")]
    return [json.dumps({"user": u, "ip": ip, "action": a, "marker": m, "seq": i, "payload": "y" * 500}) for u, ip, a, m in groups for i in range(400)]


@pytest.fixture(scope="module")
def timed(spark):
    return index.build_chunks(frame(spark, timed_lines()), "json").cache()


@pytest.fixture(scope="module")
def fields(spark):
    return index.build_chunks(frame(spark, field_lines()), "json").cache()


def found(df):
    return sorted(r["raw"] for r in df.collect())


def test_chunks_hold_all_bytes_in_order(timed):
    rows = timed.orderBy("seq").collect()
    assert "".join(r["raw"] for r in rows) == "\n".join(timed_lines()) + "\n"
    assert [r["seq"] for r in rows] == list(range(len(rows))) and len(rows) > 3
    assert all(len(r["bloom"]) == 1024 and any(r["bloom"]) for r in rows)
    assert all(r["offset"] // 65536 == r["chunk_id"] for r in rows)


def test_grouped_offsets_equal_a_plain_walk(spark):
    random.seed(3)
    lines = [(i * 40_000 + 7, "é" * random.randrange(200)) for i in range(50)]
    rows = with_chunks(spark.createDataFrame([("a", i, x) for i, x in lines], "archive_id string, line_no long, raw string"), 500).orderBy("line_no").collect()
    at = 0
    for row, (_, x) in zip(rows, lines, strict=True):
        assert (row["offset"], row["chunk_id"]) == (at, at // 500)
        at += len(x.encode()) + 1


def test_filter_has_no_false_negatives(spark, timed):
    each = index.token_positions(with_chunks(frame(spark, timed_lines()))).distinct().collect()
    blooms = {r["chunk_id"]: r["bloom"] for r in timed.collect()}
    assert all(blooms[r["chunk_id"]][r["bit"] >> 3] >> (r["bit"] & 7) & 1 for r in each)


def test_search_unique_absent_and_skips(timed):
    assert len(found(search(timed, '"day": 1, "marker"'))) == 150
    assert found(search(timed, "NOT_THERE_AT_ALL")) == []
    stats = Search("DAY1MARKER", mode="reference").stats(timed).first()
    assert stats["matches"] == 150 and stats["skipped_by_bloom"] > 0
    assert stats["total"] == stats["scanned"] + stats["skipped_by_time"] + stats["skipped_by_field"] + stats["skipped_by_bloom"]


@pytest.mark.parametrize("query", ["DAY", "AY1MARK", '"day": 2', "2025-01-16T03", " ", "", '": 1, "', "xxxx"])
@pytest.mark.parametrize("window", [(None, None), ("2025-01-16", "2025-01-16"), ("2025-01-16T05:00:00Z", None), (None, "2025-01-15T12:30:00")])
def test_exact_equals_a_full_scan(timed, query, window):
    from arclog.functions.times import date_bound

    low, high = date_bound(window[0]), date_bound(window[1], end=True)
    want = []
    for line in timed_lines():
        ts = date_bound(json.loads(line)["timestamp"])
        if query in line and (low is None or ts >= low) and (high is None or ts <= high):
            want.append(line)
    assert found(search(timed, query, frm=window[0], to=window[1])) == sorted(want)


def test_part_of_a_token(timed):
    assert len(found(search(timed, "AY1MARK"))) == 150
    assert found(search(timed, "AY1MARK", mode="reference")) == []


def test_window_prunes_chunks(timed):
    stats = Search("", "2025-01-16", "2025-01-16", mode="reference").stats(timed).first()
    assert 0 < stats["skipped_by_time"] < stats["total"]
    for frm, to in (("2024-01-01", "2024-12-31"), ("2026-01-01", None)):
        assert found(search(timed, "", frm=frm, to=to)) == []
    assert Search("DAY0MARKER").stats(timed).first()["skipped_by_time"] == 0
    with pytest.raises(ValueError):
        Search("", frm="yesterday")


def test_fields(fields):
    assert len(found(search(fields, "", user="admin"))) == 400
    assert len(found(search(fields, "", user="alice", action="logout", ip="10.0.0.1"))) == 400
    assert found(search(fields, "", user="admin", action="logout")) == []
    # the filter knows no keys: the reference reads a value under any of them
    assert len(found(search(fields, "ADMIN_LOGIN", user="login", mode="reference"))) == 400
    assert found(search(fields, "", user="login")) == []
    assert Search("", user="alice", mode="reference").stats(fields).first()["skipped_by_field"] > 0
    assert len(found(search(fields, "", user=""))) == 800


def test_plain_text_has_no_field_filter(spark):
    lines = [f"user=admin action=login seq={i}" for i in range(50)]
    chunks = index.build_chunks(frame(spark, lines), "plaintext")
    assert chunks.first()["field_bloom"] is None
    assert len(found(Search("", user="admin", mode="reference", fmt="plaintext").run(chunks))) == 50
    assert found(Search("", user="admin", fmt="plaintext").run(chunks)) == []
    rows = export.export_records(chunks, fmt="plaintext").collect()
    assert len(rows) == 50 and all(r["user"] == "" and r["raw"].startswith("user=admin") for r in rows)


def test_chain_and_tampering(spark, timed):
    linked = chain.with_chain(timed.select("archive_id", "seq", "raw")).cache()
    heads = chain.heads(linked)
    assert chain.verify(linked, heads).first()["status"] == "VERIFIED"
    n = linked.count()
    for bad in (0, 1, n - 1):
        flipped = linked.withColumn("raw", F.when(F.col("seq") == bad, F.concat(F.lit("~"), F.substring("raw", 2, 1 << 20))).otherwise(F.col("raw")))
        row = chain.verify(flipped, heads).first()
        assert (row["status"], row["bad_chunk"], row["reason"]) == ("TAMPERED", bad, "chunk")
    short = chain.verify(linked.where(F.col("seq") < n - 1), heads).first()
    assert (short["status"], short["reason"]) == ("TAMPERED", "footer")
    empty = spark.createDataFrame([("e", 0, None)], "archive_id string, num_chunks long, chain_hash string")
    row = chain.verify(linked.limit(0), empty).first()
    assert (row["status"], row["chain16"]) == ("VERIFIED", None)


def test_tables_append_and_restore(spark, tmp_path):
    path = str(tmp_path / "store")
    first, second = timed_lines()[:200], timed_lines()[200:]
    archive.create(frame(spark, first), path, "app")
    archive.create(frame(spark, ["Jan 15 10:00:00 h a: b"] * 4), path, "sys")
    archive.append(frame(spark, second), path, "app")
    rows = {r["archive_id"]: r for r in archive.archives(spark, path).collect()}
    assert rows["app"]["format"] == "json" and rows["sys"]["format"] == "syslog" and rows["app"]["version"] == 2
    assert {r["status"] for r in archive.verify(spark, path).collect()} == {"VERIFIED"}
    out = tmp_path / "back.log"
    archive.restore(archive.chunks(spark, path, "app"), str(out))
    assert out.read_text() == "\n".join(first + second) + "\n"
    assert len(found(search(archive.chunks(spark, path, "app"), "DAY1MARKER"))) == 150
    with pytest.raises(ValueError):
        archive.append(frame(spark, ["x"]), path, "nobody")


def test_export_files(spark, timed, tmp_path):
    records = export.export_records(timed, "2025-01-16", "2025-01-16")
    assert records.columns == list(t.EXPORT_COLUMNS) and records.count() == 150
    export.write_csv(records.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 150
    export.write_jsonl(records.coalesce(1), str(tmp_path / "json"))
    line = next((tmp_path / "json").glob("part-*")).read_text().splitlines()[0]
    assert list(json.loads(line)) == list(t.EXPORT_COLUMNS)
    odd = index.build_chunks(frame(spark, ["123", "abc\r", '{"user": "a,\\"b"}', "{broken"]), "json")
    rows = {r["raw"]: r["user"] for r in export.export_records(odd).collect()}
    assert rows == {"123": "", "abc": "", '{"user": "a,\\"b"}': 'a,"b', "{broken": ""}


def test_formats(spark):
    cases = {
        "one": (['{"a": 1}'], "json", "plaintext"),
        "march": (["March was cold"] * 3, "plaintext", "syslog"),
        "sys": (["Jan  5 10:00:00 host x"] * 5, "syslog", "syslog"),
        "mixed": (['{"a": 1}'] * 2 + ["text"] * 3, "plaintext", "json"),
        "numbers": (["1", "2", "3"], "json", "plaintext"),
    }
    for name, (lines, strict, quick) in cases.items():
        assert detect.detect_format(frame(spark, lines)).first()["format"] == strict, name
        assert detect.detect_format_quick(frame(spark, lines)).first()["format"] == quick, name


def test_times(spark):
    from arclog.functions import times

    cases = {
        "2025-01-15T10:23:45+02:00": 1736929425, "2025-01-15T10:23:45Z": 1736936625, "2025-01-15": 1736899200,
        "2025-01-15 10:23:45": 1736936625, "2025-01-15T10:23:45.9": 1736936625, "junk": None, "": None,
    }
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", times.iso_epoch(F.col("s")).alias("e")).collect()
        assert {r["s"]: r["e"] for r in rows} == cases
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    line = spark.createDataFrame([('{"ts": 1735689600000}',), ('{"time": 1735689600.7}',), ("Feb 30 00:00:00 x",), ("Feb  3 01:02:03 x",)], "s string")
    got = [r[0] for r in line.select(times.line_epoch(F.col("s"), F.lit("plaintext"), 2024)).collect()]
    assert got == [None, 1735689600, None, 1706922123]


def test_out_of_order_times(spark):
    lines = [json.dumps({"ts": 1_700_000_000 + k}) for k in (3, 1, 2)]
    placed = with_chunks(frame(spark, lines))
    row = index.time_zones(placed, "json").first()
    assert (row["min_ts"], row["max_ts"]) == (1_700_000_001, 1_700_000_003)
    row = index.first_last_times(placed, "json").first()
    assert (row["first_ts"], row["last_ts"]) == (1_700_000_003, 1_700_000_002)


def test_hashes_of_any_bytes(spark):
    words = ["", "admin", "žluťoučký", "\U0001f600", "a" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", t.djb2(F.col("w")).alias("a"), t.fnv1a(F.col("w")).alias("b"), t.sdbm(F.col("w")).alias("c"), bloom.positions(F.col("w"), 8192).alias("p")).collect()
    for r in rows:
        want = t.py_hashes(r["w"].encode())
        assert (r["a"], r["b"], r["c"]) == want and r["p"] == [h % 8192 for h in want]


def test_byte_chunks(spark):
    files = spark.createDataFrame([("p", bytearray(b"abcdefg")), ("empty", bytearray(b""))], "path string, content binary")
    assert [(r["chunk_id"], bytes(r["raw"])) for r in byte_chunks(files, 3).collect()] == [(0, b"abc"), (1, b"def"), (2, b"g")]


def test_an_archive_is_never_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    archive.create(frame(spark, timed_lines()), path, "a")
    with pytest.raises(FileExistsError):
        archive.create(frame(spark, ["x"]), path, "a")
    assert archive.archives(spark, path).count() == 1 and archive.verify(spark, path).first()["status"] == "VERIFIED"
    assert archive.index(spark, path, "a").agg(F.sum("n_lines")).first()[0] == 450
    # a store that cannot be read is no empty store
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "archives").mkdir()
    (tmp_path / "broken" / "archives" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        archive.create(frame(spark, ["x"]), str(tmp_path / "broken"), "a", "json")


def test_bytes_come_back_as_they_were(spark, tmp_path):
    from arclog import cli

    for i, data in enumerate([b'{"a":"z"}', b'{"a": 1}\n\n{"a\xff": "b\xfe"}\r\n\xc3\x28 caf\xc3\xa9', b"\n", b"a\n\n\n", b"x" * 70_000 + b"\ny", b""]):
        file, path = tmp_path / f"{i}.log", str(tmp_path / f"store{i}")
        file.write_bytes(data)
        archive.create(cli.lines_of(spark, str(file)), path, "a", "json")
        archive.append(cli.lines_of(spark, str(file)), path, "a") if data else None
        if data:
            archive.restore(archive.chunks(spark, path, "a"), str(tmp_path / "back"))
            assert (tmp_path / "back").read_bytes() == data * 2, data
            assert archive.index(spark, path, "a").agg(F.sum("orig_size")).first()[0] == 2 * len(data)
            assert archive.verify(spark, path).first()["status"] == "VERIFIED" == archive.verify_index(spark, path).first()["index_status"]
    path = str(tmp_path / "store1")
    assert found(archive.search(spark, path, "a", Search("caf\u00e9"))) == ["\ufffd( caf\u00e9"] * 2
    assert found(archive.search(spark, path, "a", Search("\ufffd( c"))) == ["\ufffd( caf\u00e9"] * 2
    assert {r["raw"] for r in export.export_records(archive.chunks(spark, path, "a")).collect()} == {'{"a": 1}', '{"a\ufffd": "b\ufffd"}', "\ufffd( caf\u00e9"}


def test_a_missing_filter_may_hold_anything(spark):
    chunks = index.build_chunks(frame(spark, ['{"x": "tok" y}', "other"]), "json", filters=False)
    for mode in ("exact", "reference"):
        assert found(search(chunks, '"tok" y', mode=mode)) == ['{"x": "tok" y}']


def test_stored_search_opens_only_what_the_index_leaves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PART_CHUNKS", 2)
    path = str(tmp_path / "store")
    archive.create(frame(spark, timed_lines()), path, "7", "json")
    parts = archive.index(spark, path, "7").select("part").distinct().count()
    assert parts > 2 and (tmp_path / "store/bodies/archive_id=7/version=1/part=0").exists()
    find = Search("DAY1MARKER", "2025-01-16", "2025-01-16")
    assert "raw" not in find.prunes(archive.index(spark, path, "7")).columns
    opened = archive.candidates(spark, path, "7", find).inputFiles()
    assert 0 < len({f.split("/part=")[1].split("/")[0] for f in opened}) <= parts
    plan = archive.candidates(spark, path, "7", find)._jdf.queryExecution().toString()
    assert "part#" in plan and "PartitionFilters: [" in plan and "IN (" in plan.split("PartitionFilters: [")[-1][:200]
    for named in (2000, 0):
        monkeypatch.setattr(archive, "NAMED_PARTS", named)
        for options in ({"query": "DAY1MARKER"}, {"query": "AY2"}, {"frm": "2025-01-16", "to": "2025-01-16"}, {"query": "NOT_THERE"}, {"user": "x"}):
            find = Search(**options)
            assert found(archive.search(spark, path, "7", find)) == found(find.run(archive.chunks(spark, path, "7")))
            reference = Search(mode="reference", **options)
            assert archive.search_stats(spark, path, "7", reference).first() == reference.stats(archive.chunks(spark, path, "7")).first()
    with pytest.raises(ValueError):
        archive.index(spark, path, "8")


def test_index_tampering_is_found(spark, tmp_path):
    path = str(tmp_path / "store")
    archive.create(frame(spark, timed_lines()[:300]), path, "a", "json")
    archive.append(frame(spark, timed_lines()[300:]), path, "a")
    archive.create(frame(spark, field_lines()[:100]), path, "b", "json")
    assert {r["index_status"] for r in archive.verify_index(spark, path).collect()} == {"VERIFIED"}
    entries, known = archive.index(spark, path), archive.archives(spark, path)
    here = F.col("archive_id") == "a"
    changes = {
        "max_ts": F.when(here & (F.col("seq") == 2), F.lit(5).cast("long")).otherwise(F.col("max_ts")),
        "bloom": F.when(here & (F.col("seq") == 2), F.lit(bytearray(1024))).otherwise(F.col("bloom")),
        "field_bloom": F.when(here & (F.col("seq") == 2), F.lit(bytearray(512))).otherwise(F.col("field_bloom")),
    }
    for name, value in changes.items():
        rows = {r["archive_id"]: (r["index_status"], r["bad_entry"]) for r in archive.checked_index(entries.withColumn(name, value), known).collect()}
        assert rows == {"a": ("TAMPERED", 2), "b": ("VERIFIED", None)}, name
        # with the entry's hash made anew the root still differs
        again = entries.withColumn(name, value).withColumn("index_hash", archive.entry_hash())
        rows = {r["archive_id"]: r["index_status"] for r in archive.checked_index(again, known).collect()}
        assert rows == {"a": "TAMPERED", "b": "VERIFIED"}
    last = entries.where(~(here & (F.col("seq") == 5)))
    assert {r["archive_id"]: r["index_status"] for r in archive.checked_index(last, known).collect()} == {"a": "TAMPERED", "b": "VERIFIED"}


def test_stored_sizes(spark, tmp_path):
    path = str(tmp_path / "store")
    archive.create(frame(spark, timed_lines()), path, "a", "json")
    row = archive.stored_sizes(spark, path).first()
    size = sum(f.stat().st_size for t in ("bodies", "index") for f in (tmp_path / "store" / t).rglob("*.parquet"))
    assert row["stored_bytes"] == size and row["bytes"] == sum(len(x) + 1 for x in timed_lines()) and row["ratio"] == round(row["bytes"] / size, 3) > 1


def test_json_lines_are_ascii(spark, tmp_path):
    texts = ["plain", "caf\u00e9 \u4e2d \U0001f600", 'quote " back \\ tab\t', ""]
    df = spark.createDataFrame([(x,) for x in texts], "raw string")
    export.write_jsonl(df.coalesce(1), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("part-*")).read_text("ascii").splitlines()
    assert lines == [json.dumps({"raw": x}, separators=(",", ":")) for x in texts]
