"""Embedding near-duplicates by product quantisation with exact cosine rerank.

Vectors are normalised in double precision. A coarse quantiser deals them into inverted
lists; the residual to the list's centre is coded in subspaces, and each vector keeps the
length of what its code leaves out. Two unit vectors of cosine c lie ``sqrt(2 - 2c)`` = r apart.

* Probes. If y lies in the cell of centre b and x in that of a, the plane between both cells
  separates them, so ``(|x-b|^2 - |x-a|^2) / (2 |a-b|) <= |x-y|`` along one direction. Of a
  difference of length r the share along a given direction has the spread ``r / sqrt(d)`` in d
  dimensions, so x probes every list for which the left side is at most ``SPREADS`` spreads (r
  at most), and whose nearest and farthest member leave room for r. With ``exact`` the limit is
  r itself, and no link can be missed whatever the directions; then most lists are probed.
* Codes. ``|x - y|`` is at least the table-lookup distance of x to y's code less y's left-out
  length; pairs above r by that bound are dropped, all others are reranked. That misses none.

Rerank is the cosine in double precision. Each unordered pair is examined once: x probes its
own list and those of higher number. A member travels to its list once, with its code and its
vector for the rerank; a query travels with its vector alone, which the tables are made of.

Equal vectors are one class with a count before anything is compared. Links are counted and
joined within the task that finds them; what leaves it is a count for each vector and the
edges of a spanning forest, so groups of copies never become pairs. Lists longer than
``BLOCK`` are split, and who probes them visits every part.

The quantisers are fitted on the ``SAMPLE`` classes with the smallest hashes; every vector is
indexed. The number of lists grows with the square root of the vectors, up to ``MOST_LISTS``.
Vectors of different lengths never link; each length has quantisers and a pass of its own.

Defined cases: vectors that are null, empty or zero, or with null or non-finite components link
with nothing and are kept. Rows without id
or with repeated ids each have a row and count as other vectors; a component is named after
its smallest id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import checkpointed
from arclog.llm.components import connected_components

SAMPLE = 20_000
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 64
BLOCK = 8192
#: Spreads of a random direction that probes allow for.
SPREADS = 3.0
#: Slack for sums in single precision; only more pairs are reranked by it.
SLACK = 1e-3


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centre and all squared distances."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return d.argmin(1), np.maximum(d, 0)


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows of a sample in hash order."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([_nearest(x[i : i + 4096], centres)[0] for i in range(0, len(x), 4096)])
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, distance to its centre, codes and left-out length of each row."""
        at, d = _nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = np.zeros((len(x), len(self.cuts)), np.uint8)
        left = np.zeros(len(x))
        for s, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            code, e = _nearest(rest[:, cut], book)
            codes[:, s] = code
            left += ((rest[:, cut] - book[code]) ** 2).sum(1)
        return at, np.sqrt(d[np.arange(len(x)), at]), codes, np.sqrt(left)


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    centres = _means(sample, lists)
    at = np.concatenate([_nearest(sample[i : i + 4096], centres)[0] for i in range(0, len(sample), 4096)])
    rest = sample - centres[at]
    bounds = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return Quantiser(centres, [_means(rest[:, cut], min(codes, 256)) for cut in cuts], cuts)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (row id, key) with a null key where nothing can link; classes
    (key, v, n, node): equal usable vectors once, with their number and smallest id."""
    v = F.col("v")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    kind = rows.schema["v"].dataType.elementType.simpleString()
    if kind != "float":
        rows, kind = rows.withColumn("v", v.cast("array<double>")), "double"
    # -0.0 and 0.0 are the same number
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))))
    # only ids matter for classes; the key is the vector itself, hashed twice
    key = F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))
    rows = rows.withColumn("key", key)
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return rows.select("id", "key"), checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled first, so that squares of large or tiny components stay finite
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class _Found:
    """What a task finds: link counts by node and edges of a forest."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        """Links between nodes a and b of na and nb equal vectors."""
        nodes, back = np.unique(np.r_[a, b], return_inverse=True)
        total = np.bincount(back, weights=np.r_[nb, na]).astype(np.int64)
        for node, n in zip(nodes.tolist(), total.tolist(), strict=True):
            self.counts[node] = self.counts.get(node, 0) + n
        # the links' own components first, so that the loop below sees each node once
        left, right = back[: len(a)], back[len(a) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, left, least)
            np.minimum.at(new, right, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        for x, y in zip(nodes.tolist(), nodes[label].tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        nodes = list(self.counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([self.root(x) for x in nodes], pa.int64()), pa.array([self.counts[x] for x in nodes], pa.int64())],
            names=["node", "root", "links"])


def _compare(q: dict[str, np.ndarray], m: dict[str, np.ndarray], centre: np.ndarray, model: Quantiser, cosine: float, found: _Found) -> None:
    """Queries against the members of one list (or part), in blocks of bounded memory."""
    r = np.sqrt(2 - 2 * cosine)
    rows = max(1, (1 << 21) // max(1, len(m["node"])))
    for at in range(0, len(q["node"]), rows):
        x, own = q["u"][at : at + rows], q["node"][at : at + rows]
        rest = (x - centre).astype(np.float32)
        distance = np.zeros((len(x), len(m["node"])), np.float32)
        for s, (cut, book) in enumerate(zip(model.cuts, model.books, strict=True)):
            part = rest[:, cut]
            book = book.astype(np.float32)
            look = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None]
            distance += np.take(look, m["codes"][:, s], axis=1)
        bound = (r + SLACK + m["left"]).astype(np.float32) ** 2
        near = distance <= bound
        # pairs within a list once
        i, j = np.nonzero(near & ((q["list"][at : at + rows, None] != m["list"][None]) | (own[:, None] < m["node"][None])))
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            close = np.einsum("ij,ij->i", x[a], m["u"][b]) >= cosine
            a, b = a[close], b[close]
            if len(a):
                found.add(own[a], m["node"][b], q["n"][at : at + rows][a], m["n"][b])


def _search(batches: Iterator[pa.RecordBatch], model: Quantiser, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (list, part, kind), members before queries, as ``probes`` makes them."""
    found = _Found()
    key, members, queries = None, [], []

    def stack(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = {name: whole.column(name) for name in ("node", "n", "own", "left")}
        out = {"node": column["node"].to_numpy(), "n": column["n"].to_numpy(), "list": column["own"].to_numpy(), "left": column["left"].to_numpy()}
        vectors = whole.column("v").combine_chunks()
        out["u"] = _units(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors)
        codes = whole.column("codes").to_pylist()
        if codes[0] is not None:
            out["codes"] = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        return out

    def finish() -> None:
        if members and queries:
            _compare(stack(queries), stack(members), model.centres[key[0]], model, cosine, found)
        queries.clear()

    for batch in batches:
        lists, parts, kinds = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)], strict=True):
            if a == b:
                continue
            now = (int(lists[a]), int(parts[a]))
            if now != key:
                finish()
                members.clear()
                key = now
            (queries if kinds[a] else members).append(batch.slice(a, b - a))
            if len(queries) and sum(len(x) for x in queries) > BLOCK:
                finish()
    finish()
    yield found.batch()


def links(classes: DataFrame, cosine: float, exact: bool = False) -> DataFrame:
    """(node, root, links) partial results: add ``links`` up by node; (node, root) are edges."""
    sizes = classes.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("size").collect()
    none = classes.sparkSession.createDataFrame([], "node long, root long, links long")
    return reduce(DataFrame.union, [_links(classes.where(F.size("v") == x["size"]), x["n"], cosine, exact) for x in sizes], none)


def _links(classes: DataFrame, n: int, cosine: float, exact: bool) -> DataFrame:
    """For ``n`` classes whose vectors have one length."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    model = fit(_units(sample), max(1, min(MOST_LISTS, int(2 * np.sqrt(n)))))
    share = 1.0 if exact else min(1.0, SPREADS / np.sqrt(model.centres.shape[1]))
    r = float(np.sqrt(2 - 2 * cosine)) + SLACK
    vector = classes.schema["v"].dataType.simpleString()
    kept = f"list int, radius double, v {vector}, codes binary, left double, node long, n long"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d, codes, left = model.encode(_units(batch.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(d), batch.column("v"), pa.array([c.tobytes() for c in codes]), pa.array(left), batch.column("node"), batch.column("n")],
                    names=["list", "radius", "v", "codes", "left", "node", "n"])

    indexed = checkpointed(classes.select("v", "node", "n").mapInArrow(index, kept))
    # one row for each list
    stats = {row["list"]: row for row in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()}
    lists = len(model.centres)
    size, low, high = np.zeros(lists, np.int64), np.full(lists, np.inf), np.full(lists, -np.inf)
    for at, row in stats.items():
        size[at], low[at], high[at] = row["n"], row["low"], row["high"]
    parts = np.maximum(1, -(-size // BLOCK))
    between = np.sqrt(_nearest(model.centres, model.centres)[1])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "part", "kind", "own", "node", "n", "v", "codes", "left"]
        step = max(8, 100_000 // lists)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                own = batch.column("list").to_numpy()
                node = batch.column("node").to_numpy()
                d = _nearest(_units(batch.column("v")), model.centres)[1]
                gap = d - d[np.arange(len(own)), own][:, None]
                distance = np.sqrt(d)
                reach = (gap <= 2 * share * r * between[own] + SLACK) & (distance - r <= high[None]) & (distance + r >= low[None]) & (size[None] > 0)
                reach[np.arange(len(own)), own] = True
                reach &= np.arange(lists)[None] >= own[:, None]
                row, to = np.nonzero(reach)
                times = parts[to]
                row, to = np.repeat(row, times), np.repeat(to, times)
                part = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)
                member = np.arange(len(own))
                row, to = np.r_[member, row], np.r_[own, to]
                part = np.r_[(node * 2654435761 >> 16) % parts[own], part]
                kind = np.r_[np.zeros(len(own), np.int32), np.ones(len(row) - len(own), np.int32)]
                picked = batch.take(pa.array(row))
                # who only asks needs no code
                codes = pa.concat_arrays([batch.column("codes"), pa.nulls(len(row) - len(own), pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(kind), *(picked.column(c) for c in ("list", "node", "n", "v")), codes, picked.column("left")], names=names)

    routed = indexed.mapInArrow(probe, "list int, part int, kind int, own int, node long, n long, " + f"v {vector}, codes binary, left double")
    dealt = routed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "part").sortWithinPartitions("list", "part", "kind")
    return dealt.mapInArrow(lambda batches: _search(batches, model, cosine), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, exact: bool = False) -> DataFrame:
    """One row per vector: its id, n_links (other rows linked directly), component_id (the
    smallest id that links reach) and kept (it is that id). ``exact``: see the module's text."""
    rows, classes = _classes(vectors, id_col, vector_col)
    if classes.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = checkpointed(links(classes, cosine, exact))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "node", "left").join(labels, "node", "left").select(
        "key", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").select("key", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = rows.join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
