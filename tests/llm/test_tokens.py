"""Packing, Huffman files and WARC: against the libraries themselves, on odd rows."""

import gzip
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arclog.llm import huffman, packing, warc
from arclog.llm.common import ENTRY_BYTES, Kept, of_worker
from arclog.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(VOCABULARY)
ENCODER = Encoder(VOCABULARY)

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n a", "a\n\n b", "a \n b", "it's 's", "x <|endoftext|> y", "<|endoftext|>  z",
       "  a  b", "café 中文 \U0001f600", "the the\tthe  \t the", "a\x1c b", "word " * 3000, "1 2 3 4a b5", "　　 a", "x fooª fooº µ aµb ªa b", "naïve café, naïve. l'été aé1"]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_whole_text(text):
    (ids,) = ENCODER.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t  \x1c'sa1.<|>"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_ids_equal_the_whole_text_for_any(text):
    (ids,) = ENCODER.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_forgetting_changes_nothing():
    small = Encoder(VOCABULARY, kept=1)
    for text in ODD:
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == plain(text)


def test_stores_are_bounded_by_bytes():
    kept = Kept(lambda w: (w, len(w)), most=40_000)
    for _ in range(3):
        for i in range(2000):
            assert kept[f"word{i}"] == (f"word{i}", len(f"word{i}"))
            assert sum(len(k) + ENTRY_BYTES for k in kept) == kept.held <= 40_000
    assert "word0" in kept  # what comes first stays
    # a text without spaces is one piece and is never kept
    encoder = Encoder(VOCABULARY)
    long = "a" * 100_000
    for _ in range(3):
        assert np.frombuffer(encoder.encode([long + " " + long])[0], "<u4").tolist() == plain(long + " " + long)
    assert not encoder.pieces and not encoder.pieces.held


def test_a_worker_keeps_one_thing():
    one = of_worker("one", lambda: Kept(len))
    assert of_worker("one", lambda: None) is one
    of_worker("two", dict)
    assert of_worker("one", lambda: Kept(len)) is not one


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, "again", "x"), (None, None, "x"), (3, "a", "x"), (99, "word " * 9000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_packing(docs):
    rows = packing.pieces(docs, VOCABULARY).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    whole = {}
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 and r["bucket"] == r["length"]
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for d in docs.collect():
        ids = plain(d["text"]) + [1]
        found = whole[d["doc_id"], len(ids)]
        if d["doc_id"] != 3:
            assert sum((x for _, x in sorted(found)), []) == ids
    assert packing.pieces(docs.limit(0), VOCABULARY).count() == 0


def test_piece_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 6143]:
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths) and lengths.count(2048) == n // 2048


def test_token_files(docs):
    rows = huffman.round_trip(docs, VOCABULARY).orderBy("start").collect()
    start = 0
    # rows that share an id stay in the order they were read
    want = sorted(((d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or "") for d in docs.collect()), key=lambda x: x[:2])
    assert len(rows) == len(want)
    for row, (known, doc, text) in zip(rows, want, strict=True):
        ids = plain(text) + [2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc if known else None, start, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert huffman.round_trip(docs.limit(0), VOCABULARY).count() == 0


def test_hot_ids_and_many_blocks(spark, tmp_path):
    rows = [(5, f"word {i}") for i in range(3000)] + [(None, f"none {i}") for i in range(500)] + [(1000 + i, "word " * 9000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = f"file:{tmp_path}/tokens"
    huffman.write_tokens(docs, path, VOCABULARY)
    files = sorted((tmp_path / "tokens/blocks").glob("*"))
    assert len(files) > 2 and all(f.suffix == ".huf" for f in files) and not (tmp_path / "tokens/scratch").exists()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    book = (tmp_path / "tokens/codebook.huf").read_bytes()
    table = huffman.decoding_table(np.frombuffer(book, np.uint8, 1 << 16, 8))
    # files in the order of their names hold the documents in order, without a gap
    at, ids = 0, []
    for f in files:
        for batch in huffman._read_file(pa.py_buffer(f.read_bytes()), table, schema):
            for row in batch.to_pylist():
                assert row["start"] == at
                at += row["n_tokens"]
                ids.append(row["doc_id"])
    assert ids == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    found = sorted((r["doc_id"] or -1, r["ids"]) for r in huffman.read_tokens(spark, path).collect())
    assert found == sorted((d or -1, np.array([*plain(t), 2], "<u4").tobytes()) for d, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=900), st.integers(9, 20), st.integers(1, 64))
def test_huffman_codes(ids, most, every):
    ids = np.array(ids)
    counts = np.bincount(ids, minlength=301) ** 3
    lengths = huffman.code_lengths(counts, most)
    assert lengths.max() <= most
    used = lengths[lengths > 0].astype(float)
    assert (2.0 ** -used).sum() <= 1
    payload, offsets = huffman.encode_ids(ids, huffman.canonical_codes(lengths), lengths, every)
    assert huffman.decode_ids(payload, offsets, len(ids), every, huffman.decoding_table(lengths)).tolist() == ids.tolist()


def test_huffman_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert huffman.code_lengths(counts, 20).tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    limited = huffman.code_lengths(counts, 4)
    assert limited.max() == 4 and (2.0 ** -limited.astype(float)).sum() == 1


@pytest.fixture(scope="module")
def pages(spark):
    big = "".join(chr(200 + i % 900) for i in range(60_000))
    rows = [(1, "a"), (2, "a"), (9, "a"), (3, big), (4, big + "x"), (5, None), (6, ""), (None, "n"), (7, "WARC/1.1\r\n\r\n0\r\n\r\n"), (8, big), (10, "r"), (10, "r")]
    return spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, payload string")


def test_warc(pages):
    rows = {}
    for r in warc.round_trip(pages, segment_bytes=1000).collect():
        rows.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, rows.values())) == pages.count() and all(r["whole"] for x in rows.values() for r in x)
    refers = {k: v[0]["refers_to"] for k, v in rows.items()}
    assert refers == {1: 9, 2: 9, 9: None, 3: 8, 4: None, 5: 6, 6: None, None: None, 7: None, 8: None, 10: None}
    assert len(rows[10]) == 2
    for p in pages.collect():
        data = (p["html"] or "").encode()
        for r in rows[p["page_id"]]:
            assert r["payload_bytes"] == len(data)
            assert r["payload"] == (data if r["record_type"] == "response" else None)


def test_warc_small_payloads_are_responses(pages):
    rows = warc.round_trip(pages, least_bytes=2).collect()
    assert {r["page_id"] for r in rows if r["record_type"] == "revisit"} == {3}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_without_broadcast(pages, monkeypatch):
    told = lambda df: sorted(map(str, df.select("page_id", "sha1", "response_id", "revisit").collect()))
    want = told(warc.with_roles(pages))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert told(warc.with_roles(pages)) == want and len(want) == pages.count()


def test_each_record_is_a_gzip_member(spark, pages, tmp_path):
    warc.write_warc(pages, f"file:{tmp_path}/a", segment_bytes=5000)
    files = sorted((tmp_path / "a").iterdir())
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    members = [m for f in files for m in warc.unpacked(memoryview(f.read_bytes()), 100)]
    assert all(m.startswith(b"WARC/1.1\r\n") and len(list(warc.parse(m))) == 1 for m in members) and len(members) > 50
    assert b"".join(members) == b"".join(gzip.decompress(f.read_bytes()) for f in files)
    # other writers put a whole file into one member, and write names and spaces as they like
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.warc.gz").write_bytes(gzip.compress(b"".join(members).replace(b"WARC-Type: ", b"warc-type:")))
    told = lambda df: sorted(map(str, df.drop("payload").collect()))
    assert told(warc.read_warc(spark, f"{tmp_path}/b")) == told(warc.read_warc(spark, f"{tmp_path}/a"))
    with pytest.raises(ValueError):
        list(warc.unpacked(memoryview(gzip.compress(b"x" * 1000)[:-20])))


def test_warc_missing_segment(spark, tmp_path):
    path = tmp_path / "a"
    path.mkdir()
    import gzip
    import hashlib

    sha1 = hashlib.sha1(b"x" * 5000).hexdigest()
    records = list(warc.records_of(1, b"x" * 5000, sha1, None, False, 1000))
    other = list(warc.records_of(2, b"x" * 5000, sha1, None, False, 1000))
    (path / "one.gz").write_bytes(gzip.compress(b"".join(records[::-1])) + gzip.compress(b"".join(other[:2] + other[3:])))
    rows = {r["page_id"]: r for r in warc.read_warc(spark, str(path)).collect()}
    assert rows[1]["whole"] and rows[1]["payload"] == b"x" * 5000
    assert not rows[2]["whole"] and rows[2]["payload"] is None


def test_crc_is_unsigned(docs):
    row = packing.pieces(docs.where("doc_id = 99"), VOCABULARY).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(row["ids"])
