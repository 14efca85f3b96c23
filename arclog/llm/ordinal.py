"""Quality grades by a cumulative-link regression on hashed text.

One weight vector over hashed features and ordered thresholds give the probability that a
text's grade is above each step: ``P(grade > k) = sigmoid(w.x - t_k)``, ``t_0 < t_1 < ...``.
The expected grade is the sum of these probabilities; selection uses the tail probability of
one grade.

Features are the distinct words of a whole text and their shapes (runs of letters, digits and
each other sign), hashed, and its length, share of different words, of repeated lines, of
signs and of upper-case letters in coarse steps. Shapes and steps carry over to words that
training has never seen.

Learning takes at most ``SAMPLE`` labelled documents, in the order of a hash of their ids, and
none that is held out. Scoring reads every whole text.

Defined cases: null, empty and blank texts have the feature of no words alone; documents
without id are graded and not held out; repeated rows are graded alike; without labels every
step has probability 1/2. Extra columns are kept by ``with_grades``. An empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import Kept, held_out, of_worker, parts_of

BUCKETS = 1 << 16
SAMPLE = 4000
ROUNDS = 150
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))
_SIGN = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def _buckets(word: str) -> int:
    """The bucket of a word and, in the lower 16 bits, that of its shape."""
    shape = word
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    return _bucket("w " + word.lower()) << 16 | _bucket("s " + shape[:24])


def _step(name: str, share: float) -> int:
    return _bucket(f"{name} {int(10 * min(1.0, share) + 0.5)}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text; words and shapes have length 1 together, each step too."""
    text = text or ""
    words = text.split()
    if not words:
        return np.array([_bucket("none")]), np.ones(1)
    different = set(words)
    found = np.fromiter(map(of_worker("buckets", lambda: Kept(_buckets)).__getitem__, different), np.int64, len(different))
    shapes, times = np.unique(found & 0xFFFF, return_counts=True)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    chars = sum(map(len, words))
    steps = [
        _bucket(f"length {min(12, len(words).bit_length())}"),
        _step("different", len(different) / len(words)),
        _step("lines", 1 - len(set(lines)) / max(1, len(lines))),
        _step("signs", 3 * len(_SIGN.findall(text)) / chars),
        _step("upper", len(_UPPER.findall(text)) / chars),
    ]
    values = np.r_[
        np.full(len(found), 1 / np.sqrt(len(found))),
        times / np.sqrt((times.astype(float) ** 2).sum()),
        np.ones(len(steps)),
    ]
    return np.r_[found >> 16, shapes, steps], values


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each value of w.x and each k."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds[None], -40, 40)))


def loss(pairs: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, w: np.ndarray, free: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood with the penalty, and its slopes in the weights and in
    ``free``: t_0 and the logarithms of the gaps between thresholds, which keep them in order.

    P(y) = P(> y - 1) - P(> y), taken as a product that loses no digits in the tails."""
    row = np.repeat(np.arange(len(pairs)), [len(b) for b, _ in pairs])
    bucket, value = (np.concatenate(x) for x in zip(*pairs, strict=True))
    t = np.cumsum(np.r_[free[:1], np.exp(free[1:])])
    score = np.bincount(row, weights=value * w[bucket], minlength=len(grades))
    edge = np.r_[-np.inf, t, np.inf]
    low, high = score - edge[grades], score - edge[grades + 1]
    below = lambda x: 1 / (1 + np.exp(np.clip(x, -500, 500)))
    # log(s(low) - s(high)) = log s(low) + log s(-high) + log(1 - exp(high - low))
    log_s = lambda x: -np.logaddexp(0, -x)
    gap = low - high
    total = -(log_s(low) + log_s(-high) + np.log(-np.expm1(-gap))).mean() + penalty * (w @ w) / 2
    d_score = -(below(low) - below(-high)) / len(grades)
    narrow = np.exp(-gap) / -np.expm1(-gap)  # slope of the last term in the gap
    d_edge = np.bincount(grades + 1, weights=-(below(-high) + narrow), minlength=len(edge)) + np.bincount(grades, weights=below(low) + narrow, minlength=len(edge))
    d_t = d_edge[1:-1] / len(grades)
    tail = np.cumsum(d_t[::-1])[::-1]
    return total, np.bincount(bucket, weights=value * d_score[row], minlength=len(w)) + penalty * w, np.r_[tail[:1], tail[1:] * np.exp(free[1:])]


def train(pairs: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int, rounds: int = ROUNDS, penalty: float = 3e-5) -> Model:
    """The likeliest weights and thresholds under a small penalty, by Adam on all documents, each
    given by its ``features``."""
    if not pairs:
        return Model(np.zeros(BUCKETS), np.zeros(n_grades - 1))
    y = np.array(grades)
    share = np.clip((y[:, None] > np.arange(n_grades - 1)[None]).mean(axis=0), 0.01, 0.99)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    parts = [np.zeros(BUCKETS), np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-2))]]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in parts]
    for step in range(1, rounds + 1):
        slopes = loss(pairs, y, *parts, penalty)[1:]
        for x, g, (m, v) in zip(parts, slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, free = parts
    return Model(w, np.cumsum(np.r_[free[:1], np.exp(free[1:])]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [features(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([b.astype("<i4").tobytes() for b, _ in pairs], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary())],
            names=["doc_id", "grade", "buckets", "values"])


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """A model from rated documents (doc_id, grade) that are not held out, at most ``sample``
    of them; of differing grades of a document the lowest counts, and of rows that repeat an id
    the smallest text. Features are made where the texts are; what comes to the driver is at
    most ``sample`` rows of at most a few for each bucket."""
    known = ratings.where(F.col("grade").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    # a fixed number of rows, so the broadcast has a bound
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = each.mapInArrow(_featured, f"doc_id {kind}, grade int, buckets binary, values binary").orderBy("doc_id").collect()
    pairs = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["values"], "<f4").astype(float)) for r in rows]
    return train(pairs, [r["grade"] for r in rows], n_grades)


def with_grades(docs: DataFrame, model: Model, tail: int = 1, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``expected_grade`` and ``tail``, the probability of a grade of
    at least ``tail``; columns of these names are replaced."""
    docs = docs.drop("expected_grade", "tail")
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.weights[b] @ v for x in parts_of(batch.column(at)) for b, v in map(features, x)]).reshape(-1)
            above = model.above(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above.sum(axis=1)), pa.array(np.ascontiguousarray(above[:, tail - 1]))],
                names=[*batch.schema.names, "expected_grade", "tail"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{fields}, expected_grade double, tail double")


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from 0/1 labels: 0 poor, 1 fair (good but toxic), 2 good."""
    good = F.col("quality") == 1
    return labels.select("doc_id", F.when(~good, 0).when(good & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(good, 2).alias("grade"))
