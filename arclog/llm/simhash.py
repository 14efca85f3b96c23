"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 4 bits differ in at most 4
bytes, so they share at least 4 of their 8 positional bytes: that is the guaranteed minimum
of the count filter. Lists of single positional bytes hold 1/256 of all fingerprints each, and
tallying them grows with the square of the input; so a list holds the fingerprints that agree
in three byte positions. 20 choices of three are enough for any four positions to hold one of
them (``_triples``), so a pair whose tally reaches 4 meets in a list. There the shared
positional bytes of its pairs are tallied, pairs below the minimum are dropped, and the
others are verified bit by bit.

Exact copies share a fingerprint and enter the index once. Within a list no pairs are
emitted: the members that are linked, directly or through each other, are joined by a search
that drops what it has reached, and each emits one edge to the smallest of its group. In a
list of more than ``LONG`` members that search ends after ``ROOTS`` groups; members that no
group has reached are dealt anew by the same rule: the bits that their list does not fix are
cut into 8 parts, of which they too share 4, and 20 lists for three parts take them. After a
few such turns so many bits are fixed that a list is short, so no task compares a long list
of strangers. The edges' connected components are found by alternating stars over
checkpointed tables.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like
any other. A row without id has a fingerprint but no component and links with nothing.
Repeated rows each get a row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import checkpointed, free_name, shared_folder
from arclog.llm.components import connected_components

SEED = 42
SHINGLE = 4
BYTES = 8
#: Members from which on a list is long, and groups that are sought in a long one.
LONG = 4096
ROOTS = 64
#: Shingles whose bits are counted at once; bounds the memory a long text takes.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", column: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, each with its fingerprint as a signed long; a column of that name
    is replaced."""
    docs = docs.drop(column)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{fields}, `{column}` long")


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of the numbers 0 to 7, of which any four numbers hold one. The numbers form
    the groups 012, 345 and 67; a triple is a whole group of three, or two of one group and one
    of the next. Four numbers have three in one group, or two in a group and one in the next."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [g for g in groups if len(g) == 3]
    for g, after in zip(groups, groups[1:] + groups[:1], strict=True):
        found += [(*two, one) for two in combinations(g, 2) for one in after]
    return found


@lru_cache(maxsize=1 << 12)
def _masks(fixed: int, most: int) -> list[int]:
    """The bits that lists fix beyond ``fixed``: the others are cut into 8 parts, and any two
    fingerprints that differ in ``most`` bits agree in one choice of parts at least."""
    free = [bit for bit in range(64) if not fixed >> bit & 1]
    cuts = [len(free) * i // BYTES for i in range(BYTES + 1)]
    parts = [sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    chosen = _triples() if BYTES - most == 4 else combinations(range(BYTES), BYTES - most)
    return [fixed | sum(parts[i] for i in some) for some in chosen]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(left: np.ndarray, one: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints differ from others in at most ``most`` bits: the tally of shared
    positional bytes first, then the bits of those that reach the minimum."""
    differ = left ^ one
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = shared >= BYTES - most
    near[near] = np.bitwise_count(differ[near]) <= most
    return near


def linked_groups(prints: np.ndarray, most: int, roots: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of some distinct fingerprints the index of its group's first member, and the
    indices that no group has reached after ``roots`` groups: they link among themselves only.

    A member that has been reached is never compared as a target again, so a dense group
    costs little more than its size; strangers cost one vectorised comparison each.
    """
    group = np.arange(len(prints))
    left = np.arange(len(prints))
    while len(left) and roots != 0:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = _near(prints[left], prints[frontier.pop()], most)
            found = left[near]
            if len(found):
                group[found] = root
                frontier.extend(found.tolist())
                left = left[~near]
        roots = None if roots is None else roots - 1
    return group, left


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fixed", pa.int64())])


def _edges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (fixed, key, fp, node) sorted by list in. Out: edges (a, b) between the members of
    linked groups, and of long lists the members to be dealt anew (fingerprint, node, fixed)."""

    def of(fixed: np.ndarray, key: np.ndarray, prints: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        size = ends - starts
        pairs = starts[size == 2]
        pairs = pairs[_near(prints[pairs], prints[pairs + 1], most)]
        left, right, again = [node[pairs]], [node[pairs + 1]], [np.zeros(0, np.int64)]
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            group, rest = linked_groups(prints[a:b], most, ROOTS if b - a > LONG else None)
            ids = node[a:b]
            linked = group != np.arange(b - a)
            left.append(ids[group[linked]])
            right.append(ids[linked])
            again.append(a + rest)
        a, b, rest = np.concatenate(left), np.concatenate(right), np.concatenate(again)
        unique = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[unique[0], prints[rest].view(np.int64)]), pa.array(np.r_[unique[1], node[rest]]), pa.array(np.r_[np.zeros(unique.shape[1], np.int64), fixed[rest]])], schema=EDGES)

    held: list[list[np.ndarray]] = []

    def lists(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        fixed, key, prints, node = (np.concatenate(x) for x in zip(*parts, strict=True))
        return of(fixed, key, prints.view(np.uint64), node)

    for batch in batches:
        now = [np.asarray(column) for column in batch.columns]
        if not len(now[0]):
            continue
        # the last list may go on in the next batch
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        new = held and (now[0][0] != held[-1][0][-1] or now[1][0] != held[-1][1][-1])
        if held and (cut or new):
            yield lists([*held, [x[:cut] for x in now]])
            held = []
        elif cut:
            yield lists([[x[:cut] for x in now]])
        held.append([x[cut:] for x in now])
    if held:
        yield lists(held)


def _dealt(postings: DataFrame, most: int) -> DataFrame:
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.repartition(parts, "fixed", "key").sortWithinPartitions("fixed", "key", "fp")
    return checkpointed(ordered.mapInArrow(lambda batches: _edges(batches, most), "a long, b long, fixed long").distinct())


def _postings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (fp, node, fixed) in, their postings under the next masks out."""
    for batch in batches:
        prints, node, fixed = (np.asarray(column) for column in batch.columns)
        for at in np.unique(fixed).tolist():
            here = fixed == at
            for mask in map(_signed, _masks(at % (1 << 64), most)):
                own = prints[here]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mask)), pa.array(own & mask), pa.array(own), pa.array(node[here])], names=["fixed", "key", "fp", "node"])


def fingerprint_links(classes: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) that connect every two nodes whose fingerprints differ in at most ``most``
    bits, directly or through others. ``classes``: (node, fp), each fingerprint once."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in _masks(0, most)])
    found = _dealt(
        classes.select(F.col("fp"), F.col("node"), F.explode(masks).alias("fixed"))
        .select("fixed", F.col("fp").bitwiseAND(F.col("fixed")).alias("key"), "fp", "node"), most)
    edges = found.where("fixed = 0")
    while not (again := found.where("fixed <> 0")).isEmpty():
        postings = again.select(F.col("a").alias("fp"), F.col("b").alias("node"), "fixed").mapInArrow(
            lambda batches: _postings(batches, most), "fixed long, key long, fp long, node long")
        found = _dealt(postings, most)
        edges = edges.union(found.where("fixed = 0"))
    return edges.select("a", "b")


def components_of(prints: DataFrame, id_col: str = "doc_id", most: int = 4) -> DataFrame:
    """(fp, component) for every fingerprint of ``prints`` that has an id; component is the
    smallest id that links reach. ``prints``: rows with ``id_col`` and fp."""
    classes = checkpointed(
        prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node"))
    )
    labels = connected_components(fingerprint_links(classes, most))
    return classes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with its smallest
    id stays, one of them where the id is repeated; rows without id all stay."""
    spark = docs.sparkSession
    path = shared_folder(spark, "simhash")
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    with_fingerprints(docs, text_col, fp, shingle).withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    prints = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    found = prints.join(components_of(prints, "id", most), "fp")
    kept = found.where("id = component").groupBy("component").agg(F.min("row").alias(row)).select(row)
    kept = kept.union(prints.where("id IS NULL").select("row"))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = 4) -> DataFrame:
    """One row per document: its id, its fingerprint (16 hex digits) and its component."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = checkpointed(with_fingerprints(slim, "text", "fp", shingle).select("doc_id", "fp"))
    found = prints.join(components_of(prints, "doc_id", most), "fp", "left")
    return found.select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
