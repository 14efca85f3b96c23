"""Toxicity by a subsequence string kernel on words, Nyström landmarks and a linear SVM.

The kernel of two words sums over their common subsequences of ``ORDER`` characters, gaps
decayed by ``DECAY`` for every character they span, and is normalised to 1 for equal words.
So ``idxiot`` stays close to ``idiot``. Punctuation inside a word is left out, and runs of
single characters, as in ``i d i o t``, are read as one word as well.

Landmarks are all words that speak for the label toxic but those within 0.9 of a stronger one,
so each telling word is covered, and the harmless words that come closest to them, at least
half as many. Their number has no bound but that of the training sample. The kernels of a word to the landmarks, whitened by
the landmarks' own kernel matrix (Nyström), are its features; those of a sentence are the
largest over its words. A linear SVM is trained on sentences: all of harmless documents against
those of toxic documents that are toxic, at first the ones with a telling word, then those that
the model itself finds, in ``ROUNDS`` rounds; and, with less weight, against the telling words
with a character inserted. Sentences with the same close words are one row with their count, so
training holds no sentence. A document scores by its two most toxic words, each as a sentence of
its own, as a single one may be chance: how much each counts is learned from the labelled
documents.

Labels are known for documents, of which near-copies are left out of training: all sentences
of harmless documents are harmless, and in toxic ones those words count that chance does not
explain.

Learning takes at most ``SAMPLE`` labelled documents of each label, in the order of a hash of
their ids, so the driver's share does not grow. Scoring reads every whole text.

Defined cases: null, empty and blank texts have no sentence and score like a sentence without
any known word. Documents without id are scored and are not held out. Repeated rows are
scored alike and count once in learning. Without labels of both kinds, or without any telling word,
every score is 0. Extra columns are kept by
``with_scores``, one named like the score is replaced, and ignored by the query. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import ENTRY_BYTES, KEPT_BYTES, KEPT_KEY, held_out, of_worker, parts_of

ORDER = 3
DECAY = 0.9
#: Kernels below this count as 0, in training and scoring alike.
FLOOR = 0.5
#: Landmarks that harmless words fill up to; more if the telling words need more than two thirds.
LANDMARKS = 96
#: Pairs of words whose kernels are computed together; their tables stay in the cache.
ROWS = 1024
#: Words that are prepared together, and texts.
BLOCK = 20_000
GROUP = 256
#: Scores from here on mean toxic.
THRESHOLD = 0.7
#: Times that the toxic sentences are sought anew.
ROUNDS = 3
#: Labelled documents of each label that learning takes at most.
SAMPLE = 1500
#: Words of more characters are compared in windows, whose length fits the landmark.
WINDOW = 24
#: Subsequences that are looked up together.
TRIPLES = 100_000
#: Landmarks of a group, for which one bound is computed.
NEIGHBOURS = 8
#: Cells of a block of kernels that are summed up together.
CELLS = 1 << 18

SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
PUNCTUATION = dict.fromkeys(map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
#: What a text has if SINGLES finds anything in one of its sentences.
SINGLES_HERE = re.compile(r"(?<!\S)\S\s\S\s\S(?=[\s.!?]|$)")
SINGLES = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){2,}")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, zeros behind."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width)


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The unnormalised kernels of words, row by row of two arrays of code points."""
    total = np.zeros(len(left))
    for at in range(0, len(left), ROWS):
        total[at : at + ROWS] = _kernel_of_some(left[at : at + ROWS].T, right[at : at + ROWS].T, order, decay)
    return total


def _kernel_of_some(left: np.ndarray, right: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Columns are words. ``before[i, j]`` holds the decayed matches of the subsequences found
    so far in the first i and j characters."""
    (m, n), (k, _) = left.shape, right.shape
    equal = ((left[:, None] == right[None, :]) & (left[:, None] > 0)) * (decay * decay)
    before = np.ones((m + 1, k + 1, n))
    run, found = np.empty(n), np.empty(n)
    for _ in range(order - 1):
        now = np.zeros_like(before)
        for i in range(1, m + 1):
            run[:] = 0
            for j in range(1, k + 1):
                np.multiply(equal[i - 1, j - 1], before[i - 1, j - 1], out=found)
                run *= decay
                run += found
                np.multiply(now[i - 1, j], decay, out=now[i, j])
                now[i, j] += run
        before = now
    return (equal * before[:-1, :-1]).sum(axis=(0, 1))


def _self_kernel(words: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    return subsequence_kernel(words, words)


@lru_cache(maxsize=WINDOW)
def _triples(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of every ``ORDER`` characters of a word, and what gaps leave of each."""
    at = np.array(list(combinations(range(width), ORDER)), np.intp).reshape(-1, ORDER).T
    return at, DECAY ** (at[-1] - at[0] + 1.0)


def _windows(word: str, length: int) -> set[str]:
    """Parts of a long word that fit landmarks of ``length``: about a fourth longer, so that the
    rest of a window does not hide one; each ``length`` + 1 characters are whole in one."""
    more = max(1, length // 4)
    size = min(WINDOW, length + more)
    last = len(word) - size
    return {word[i : i + size] for i in [*range(0, last, size - length or 1), last]}


@lru_cache(maxsize=1)
def _distinct_norms() -> np.ndarray:
    """By length the least norm that a word can have: that of different characters only."""
    norms = np.zeros(WINDOW + 1)
    for length in range(ORDER, WINDOW + 1):
        norms[length] = np.sqrt(_self_kernel(np.arange(1, length + 1, dtype=np.uint32)[None])[0])
    return norms


class Kernels:
    """Normalised kernels of words with the landmarks; those below FLOOR count as 0. A word
    close to no landmark has None.

    The subsequences of the landmarks are numbered and have the landmarks' weights as rows, so
    a word's kernels with all landmarks are the sum of the rows of its own subsequences. Before
    that, a word is left out only if the sum of each row's largest weight, divided by the least
    norm of its length, is below FLOOR: no kernel of it can reach FLOOR then. The largest weight
    is taken over all landmarks first, then over each group of NEIGHBOURS that are alike.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = codes = _codes(landmarks, WINDOW) if landmarks else np.zeros((0, WINDOW), np.uint32)
        self.norms = np.sqrt(_self_kernel(codes)) if landmarks else np.zeros(0)
        self.lengths = np.array([len(z) for z in landmarks], int)
        self.least = _distinct_norms()
        self.letters = np.unique(np.append(codes, 0))
        at, decayed = _triples(WINDOW)
        keys = self._keys(codes, at)
        self.known = np.unique(np.append(keys, -1))
        place = np.searchsorted(self.known, keys)
        self.rows = np.zeros((len(self.known), len(landmarks)))
        for z in range(len(landmarks)):
            self.rows[:, z] = np.bincount(place[z], decayed, len(self.known)) / self.norms[z]
        self.rows[0] = 0  # that of -1, subsequences of no landmark
        self.most = self.rows.max(axis=1, initial=0.0)
        self.most_near = np.stack([self.rows[:, some].max(axis=1) for some in self._groups()] or [self.most], axis=1)
        # where there are few letters, a table is faster than a search
        self.table = None
        if len(self.letters) <= 200:
            self.table = np.zeros(len(self.letters) ** ORDER, np.int32)
            self.table[self.known[1:]] = np.arange(1, len(self.known))

    def gram(self) -> np.ndarray:
        """The normalised kernels of the landmarks with each other."""
        out = np.zeros((len(self.landmarks), len(self.landmarks)))
        for z in range(len(self.landmarks)):
            out[:, z] = subsequence_kernel(self.codes, np.repeat(self.codes[z : z + 1], len(out), axis=0)) / (self.norms * self.norms[z])
        return (out + out.T) / 2

    def _groups(self) -> list[list[int]]:
        gram, left, out = self.gram(), list(range(len(self.landmarks))), []
        while left:
            out.append(sorted(left, key=lambda z: -gram[left[0], z])[:NEIGHBOURS])
            left = [z for z in left if z not in out[-1]]
        return out

    def _keys(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Subsequences as numbers; -1 with a character that no landmark has."""
        letter = np.searchsorted(self.letters, codes)
        letter[self.letters[np.minimum(letter, len(self.letters) - 1)] != codes] = 0
        first, second, third = (letter[:, x] for x in at)
        key = (first * len(self.letters) + second) * len(self.letters) + third
        key[(first == 0) | (second == 0) | (third == 0)] = -1
        return key

    def _places(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = self._keys(codes, at)
        if self.table is not None:
            return np.where(keys < 0, 0, self.table[keys])
        found = np.searchsorted(self.known, keys)
        return np.where(self.known[np.minimum(found, len(self.known) - 1)] == keys, found, 0)

    def _of(self, words: list[str]) -> list[np.ndarray | None]:
        """For words of at most WINDOW characters."""
        found: list[np.ndarray | None] = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) >= ORDER:
                by_width.setdefault(len(word), []).append(i)
        for width, every in by_width.items():
            at, decayed = _triples(width)
            step = max(1, TRIPLES // len(decayed))
            for start in range(0, len(every), step):
                members = every[start : start + step]
                codes = _codes([words[i] for i in members], width)
                places = self._places(codes, at)
                some = np.flatnonzero(self.most[places] @ decayed >= FLOOR * self.least[width] * (1 - 1e-9))
                if len(some):
                    some = some[self._sums(places[some], decayed, self.most_near).max(axis=1) >= FLOOR * self.least[width] * (1 - 1e-9)]
                if not len(some):
                    continue
                kernel = self._sums(places[some], decayed, self.rows)
                near = kernel.max(axis=1) >= FLOOR * self.least[width] * (1 - 1e-9)
                some, kernel = some[near], kernel[near]
                if len(some):
                    kernel /= np.sqrt(_self_kernel(codes[some]))[:, None]
                kernel[kernel < FLOOR] = 0.0
                for row, vector in zip(some.tolist(), kernel, strict=True):
                    if vector.any():
                        found[members[row]] = vector
        return found

    @staticmethod
    def _sums(places: np.ndarray, decayed: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each word the decayed sum of its subsequences' rows, in blocks of bounded memory."""
        kernel = np.zeros((len(places), rows.shape[1]))
        row, at = np.nonzero(places)
        step = max(1, CELLS // max(1, rows.shape[1]))
        for a in range(0, len(row), step):
            own, x = row[a : a + step], at[a : a + step]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            kernel[own[first]] += np.add.reduceat(rows[places[own, x]] * decayed[x, None], first)
        return kernel

    def _of_long(self, word: str) -> np.ndarray | None:
        """The largest kernels over a long word's windows, each for the landmarks that it fits."""
        out = np.zeros(len(self.landmarks))
        for length in np.unique(self.lengths).tolist():
            fits = self.lengths == length
            near = [v for v in self._of(sorted(_windows(word, length))) if v is not None]
            if near:
                out[fits] = np.max(near, axis=0)[fits]
        return out if out.any() else None

    def of(self, words: list[str]) -> list[np.ndarray | None]:
        """The kernels of each word, the largest over the windows of a long one."""
        out: list[np.ndarray | None] = []
        for at in range(0, len(words), BLOCK):
            some = words[at : at + BLOCK]
            short = iter(self._of([w for w in some if len(w) <= WINDOW]))
            out += [next(short) if len(w) <= WINDOW else self._of_long(w) for w in some]
        return out


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE.split((text or "").lower()) if s and not s.isspace()]


def words_in(sentence: str) -> list[str]:
    """The words of a sentence without punctuation; runs of three or more single characters
    count as one word too."""
    words = sentence.translate(PUNCTUATION).split()
    if len([w for w in words if len(w) == 1]) > 2:
        words += ["".join(run.split()) for run in SINGLES.findall(sentence)]
    return words


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin @ self.slopes + self.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = penalty * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        slack = 1 - y * (a @ w)
        active = slack > 0
        b, c = a[active], weight[active]
        new = np.linalg.solve(b.T @ (b * c[:, None]) + ridge, b.T @ (c * y[active]))
        step = np.abs(new - w).max()
        w = 0.5 * w + 0.5 * new if _ > 5 else new
        if step < 1e-7:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str | None], labels: list[int], landmarks: int = LANDMARKS) -> Model:
    """A model from labelled documents; see the module's text for what is learned."""
    documents, y, own, known = [], [], [], set()
    for text, label in zip(texts, labels, strict=True):
        cut = sentences(text)
        # copies would make every word of theirs tell of their label
        if cut and sum(s in known for s in cut) > len(cut) / 2:
            continue
        known.update(cut)
        documents.append({intern(w) for s in cut for w in words_in(s) if len(w) >= ORDER})
        y.append(label)
        own.append(text)
    del known
    y = np.array(y, int)
    n = [int((y == 0).sum()), int(y.sum())]
    if not all(n):
        return Model([], np.zeros(0), 0.0, np.zeros(2), -40.0)
    seen = [Counter(), Counter()]
    for document, label in zip(documents, y, strict=True):
        seen[label].update(document)

    def association(a: int, b: int) -> float:
        """Log-likelihood ratio of the label toxic and what a toxic documents and b harmless
        ones have; 0 unless harmless documents hardly have it. Long documents have more of
        everything, so a ratio alone would find words of long documents."""
        if b * n[1] > 0.03 * a * n[0]:
            return 0.0
        p = (a + b) / (n[0] + n[1])
        return sum(x * np.log(x / m / q) for k, m in ((a, n[1]), (b, n[0])) for x, q in ((k, p), (m - k, 1 - p)) if x and q)

    strength = {w: association(a, seen[0][w]) for w, a in seen[1].items() if len(w) <= WINDOW}
    ranked = sorted((w for w, x in strength.items() if x > 0), key=lambda w: (-strength[w], w))
    # words that chance does not explain among so many
    least = np.log(max(2, len(strength))) + 1
    telling = [w for w in ranked if strength[w] > least]
    if not telling:
        return Model([], np.zeros(0), 0.0, np.zeros(2), -40.0)
    toxic: list[str] = []
    covered = np.zeros(len(telling))
    for i, vector in enumerate(Kernels(telling).of(telling)):
        if covered[i] < 0.9:
            toxic.append(telling[i])
            covered = np.maximum(covered, vector if vector is not None else 0)
    harmless = sorted(set(seen[0]).difference(telling))
    closest = sorted((-v.max() * np.log1p(seen[0][w]), w) for w, v in zip(harmless, Kernels(toxic).of(harmless), strict=True) if v is not None and len(w) <= WINDOW)
    chosen = toxic + [w for _, w in closest[: max(landmarks - len(toxic), len(toxic) // 2)]]
    kernels = Kernels(chosen)
    value, vector = np.linalg.eigh(kernels.gram())
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T

    # each telling word with a character inserted, at every place
    altered = [w[:i] + "xqjzk"[i % 5] + w[i:] for w in toxic for i in range(1, len(w))]
    spoilt = np.stack([v for v in kernels.of(altered) if v is not None] or [np.zeros(len(chosen))]) @ whiten
    every = sorted(set(seen[0]).union(seen[1]))
    near = {w: v for w, v in zip(every, kernels.of(every), strict=True) if v is not None}
    del every, seen
    # sentences that have the same words close to landmarks are one row with their count
    count = [Counter(), Counter()]
    for text, label in zip(own, y, strict=True):
        count[label].update(frozenset(near.keys() & words_in(s)) for s in sentences(text))
    none = frozenset()
    clean, said = ([x for x in sorted(c, key=sorted) if x != none] for c in count)
    vectors = lambda some: np.stack([np.max([near[w] for w in x], axis=0) for x in some] or [np.zeros(len(chosen))]) @ whiten
    x0, x1 = vectors(clean), vectors(said)
    times0, times1 = (np.array([c[x] for x in some] or [1], float) for c, some in ((count[0], clean), (count[1], said)))
    told = set(telling)
    positive = np.array([not told.isdisjoint(x) for x in said])
    for _ in range(ROUNDS):
        rows = [x0, x1[positive], spoilt, np.zeros((1, len(chosen)))]
        weight = [0.45 * times0 / times0.sum(), 0.4 * times1[positive] / times1[positive].sum(), np.full(len(spoilt), 0.1 / len(spoilt)), [0.05]]
        sign = np.repeat([-1.0, 1.0, 1.0, -1.0], [len(r) for r in rows])
        w, b = _svm(np.vstack(rows), sign, np.concatenate(weight))
        before, positive = positive, x1 @ w + b > 0
        if not positive.any() or (positive == before).all():
            break
    model = Model(chosen, whiten @ w, b, np.ones(2), 0.0)
    margin = margins([t for t in texts], model)
    every = np.array(labels, int)
    target = np.where(every == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    slopes, shift = _logistic(margin, target)
    if slopes[0] < 0:  # more of a margin never makes a text less toxic
        rest, shift = _logistic(margin[:, 1:], target)
        slopes = np.r_[0.0, rest]
    model.slopes, model.shift = np.maximum(slopes, 0), shift
    return model


def _logistic(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt's calibration for some margins, by Newton steps with a slight pull towards 1; a step
    is halved until the loss falls, so it cannot run past the least loss."""
    a, aim = np.hstack([x, np.ones((len(x), 1))]), np.r_[np.ones(x.shape[1]), 0.0]
    pull = np.r_[np.full(x.shape[1], 0.1), 1e-6]
    loss = lambda p: (np.logaddexp(0, a @ p) - target * (a @ p)).sum() + (pull * (p - aim) ** 2).sum() / 2
    p, now = aim, loss(aim)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ p, -30, 30)))
        h = a.T @ (a * (q * (1 - q))[:, None]) + np.diag(pull)
        step = np.linalg.solve(h, a.T @ (q - target) + pull * (p - aim))
        while np.abs(step).max() >= 1e-8 and not loss(p - step) < now:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        p = p - step
        now = loss(p)
    return p[:-1], float(p[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out; at most ``sample`` of each
    label come to the driver. A document with differing labels counts as toxic; of rows that
    repeat an id the smallest text is learned from."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    # the smallest hashes of each label; a fixed number of rows, so a broadcast has a bound
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    rows = found.orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


class Margins:
    """What each word adds to the margin of a text without any word close to a landmark. Words
    stand here as they are in texts, punctuation and all; those that add nothing are only known
    as such. Half of what is kept goes when KEPT_BYTES is reached, the words seen longest ago."""

    def __init__(self, model: Model, most: int = KEPT_BYTES):
        self.kernels, self.weights, self.half = Kernels(model.landmarks), model.weights, most // 2
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}
        self.told: dict[str, float] = {}  # those of young that add something
        self.held = 0

    def of(self, words: set[str]) -> dict[str, float]:
        """The margins of those words that have one above 0."""
        new = [w for w in words if w not in self.young]
        found = {w: self.old[w] for w in new if w in self.old}
        every = [w for w in new if w not in found]
        for at in range(0, len(every), BLOCK):
            some = every[at : at + BLOCK]
            plain = [w if w.isalnum() else w.translate(PUNCTUATION) for w in some]
            each = sorted({w for w in plain if len(w) >= ORDER})
            told = {w: m for w, v in zip(each, self.kernels.of(each), strict=True) if v is not None and (m := float(v @ self.weights)) > 0}
            found.update((w, told.get(p, 0.0)) for w, p in zip(some, plain, strict=True))
        out = {w: m for w, m in found.items() if m}
        out.update((w, m) for w, m in self.told.items() if w in words)
        for w in [w for w in found if len(w) > KEPT_KEY]:
            del found[w]
        self.held += sum(map(len, found)) + ENTRY_BYTES * len(found)
        if self.held > self.half:
            self.old, self.young, self.told, self.held = self.young, {}, {}, 0
        self.young.update(found)
        self.told.update((w, m) for w, m in found.items() if m)
        return out


def words_of_text(text: str | None) -> list[str]:
    """The words of all sentences, punctuation not yet left out; runs of single characters as in
    ``words_in``."""
    low = (text or "").lower()
    words = low.split()
    if SINGLES_HERE.search(low):
        for s in sentences(low):
            own = words_in(s)
            words += own[len(s.translate(PUNCTUATION).split()) :]
    return words


def margins(texts: list[str | None], model: Model) -> np.ndarray:
    """For each document the margin of its most toxic word and what the second one adds to that
    of none; a word that stands twice is both."""
    key = ("margins", "\n".join(model.landmarks), model.weights.tobytes())
    kept, out = of_worker(key, lambda: Margins(model)), np.zeros((len(texts), 2))
    for at in range(0, len(texts), GROUP):
        cut = list(map(words_of_text, texts[at : at + GROUP]))
        every = list(map(set, cut))
        # words below the margin of none change nothing
        known = kept.of(set().union(*every))
        for i, words in enumerate(every):
            if not words.isdisjoint(known):
                best = sorted((known[w] for w in cut[i] if w in known), reverse=True)[:2]
                out[at + i, : len(best)] = best
    out[:, 0] += model.bias
    return out


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """The rows of ``docs`` with one more column, the score from 0 to 1; a column of that name is
    replaced."""
    docs = docs.drop(column)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros((0, 2)), *(margins(texts, model) for texts in parts_of(batch.column(at), GROUP))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(found))], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{fields}, `{column}` double")


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")
