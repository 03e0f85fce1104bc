"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words, lower-cased and without marks at their ends, and the words' first letters
(4 and 5 of them), hashed into buckets.  Over all buckets that the training sample has, a second-order factorization machine is fitted: linear weights, and a vector for each term whose inner products
weigh pairs of terms.

Defined cases: texts of any length are scored by all of their terms; documents with equal terms tie, with equal scores; null and empty texts have no terms and get the score of the bias; without labels of both kinds every
score is 0; repeated rows get the same score; an empty table gives an empty result; columns besides ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import Memory, fold, labelled_sample, map_arrow

BUCKETS = 1 << 20
MARKS = " \t\n\v\f\r.,;:!?\"'()[]{}<>*#$%&|/\\~_-«»„“”‘’¿¡…"


def bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) % BUCKETS


class Starts(Memory):
    """First letters: their bucket."""

    def find(self, letters: str) -> int:
        return bucket("p" + letters)


class Terms(Memory):
    """word: its terms, or with ``kept`` the places of those that the machine knows."""

    def __init__(self, kept: dict[int, int] | None = None):
        super().__init__()
        self.kept, self.starts = kept, Starts()

    def find(self, word: str) -> tuple[int, ...]:
        word = word.strip(MARKS)
        if not word:
            return ()
        found = [bucket("w" + word), *(self.starts[word[:n]] for n in (4, 5) if len(word) >= n)]
        return tuple(found) if self.kept is None else tuple([self.kept[t] for t in found if t in self.kept])

    def of(self, text: str | None) -> list[int]:
        return list(set().union(*map(self.__getitem__, set((text or "").lower().split()))))


@dataclass(frozen=True)
class Machine:
    kept: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Of the terms of many documents at once, as the rows of a sparse matrix."""
        if not len(self.linear):
            return np.zeros(len(rows))
        lengths = np.array([len(r) for r in rows], np.int64)
        full = np.flatnonzero(lengths)
        z = np.full(len(rows), self.bias)
        if len(full):
            at = np.fromiter((t for r in rows for t in r), np.int64, int(lengths.sum()))
            values = np.column_stack([self.linear, self.factors, (self.factors**2).sum(1)])
            sums = summed(values, at, (np.cumsum(lengths) - lengths)[full])
            z[full] += sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def score(self, active: list[int]) -> float:
        return float(self.scores([active])[0])


def summed(values: np.ndarray, at: np.ndarray, starts: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """For each stretch of ``at`` that begins at one of ``starts``, the sum of the rows of ``values`` that it names."""
    out = np.empty((len(starts), values.shape[1]), values.dtype)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + block)))
        stop = starts[last] if last < len(starts) else len(at)
        out[first:last] = np.add.reduceat(values[at[starts[first] : stop]], starts[first:last] - starts[first], axis=0)
        first = last
    return out


def fit(rows: list[tuple[np.ndarray, int]], rank: int = 4, steps: int = 150, seed: int = 11) -> Machine:
    """rows: (term buckets, label).

    All terms of the rows are fitted together.  A term's weight costs as much as one row, half a
    row of each label, can pull, its vector's length twice that, so that what single rows have does not pay; accelerated proximal
    gradients find them.  Terms that end with neither weight nor vector change no score and are left out.
    """
    y = np.array([label for _, label in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Machine({}, 0.0, np.zeros(0), np.zeros((0, rank)))
    lengths = np.array([len(at) for at, _ in rows])
    chosen, cols = np.unique(np.concatenate([at for at, _ in rows]), return_inverse=True)
    if not len(chosen):
        return Machine({0: 0}, 0.0, np.zeros(1), np.zeros((1, rank)))
    # Rows that have terms, where their terms begin in cols, and the same the other way round: the rows of each term.
    full = np.flatnonzero(lengths)
    begins = (np.cumsum(lengths) - lengths)[full]
    cols = cols.astype(np.int32)
    by_term = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)[np.argsort(cols, kind="stable")]
    term_begins = np.searchsorted(np.sort(cols), np.arange(len(chosen)))

    def of_rows(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), values.shape[1]))
        out[full] = summed(values.astype(np.float32), cols, begins)
        return out

    def of_terms(values: np.ndarray) -> np.ndarray:
        return summed(values.astype(np.float32), by_term, term_begins).astype(np.float64)

    share = y.mean()
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    mean = of_terms(weight[:, None])[:, 0]
    # The largest curvature of the weights, with terms taken from their means: what bounds a step.
    u = rng.normal(size=(len(chosen), 1))
    for _ in range(12):
        u /= np.linalg.norm(u)
        q = (of_rows(u) - mean @ u) * weight[:, None] / 4
        last, u = u, of_terms(q) - mean[:, None] * q.sum()
    step = 1 / (1.2 * float((last * u).sum()) + 1e-4)
    cost = step * 0.25 * (1 / share + 1 / (1 - share)) / len(y)
    now = [np.zeros(1), np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank))]
    before, best, t = [p.copy() for p in now], np.inf, 0
    for _ in range(steps):
        t += 1
        b, w, v = (p + (t - 1) / (t + 2) * (p - old) for p, old in zip(now, before))
        sums = of_rows(np.column_stack([w, v, (v * v).sum(1)]))
        xv = sums[:, 1:-1]
        s = b + sums[:, 0] - mean @ w + 0.5 * ((xv**2).sum(1) - sums[:, -1])
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -s, s))).sum()) + cost / step * float(np.abs(w).sum() + 2 * np.sqrt((v * v).sum(1)).sum())
        if not loss <= best * 1.02:
            # Too far: back to the last place, without momentum, in shorter steps; vectors bend more as they grow.
            now, step, cost, t, best = before, step / 2, cost / 2, 0, np.inf
            before = [p.copy() for p in now]
            continue
        best = loss
        g = (1.0 / (1.0 + np.exp(-np.clip(s, -30, 30))) - y) * weight
        back = of_terms(np.column_stack([g, g[:, None] * xv]))
        w = w - step * (back[:, 0] - mean * g.sum())
        v = v - step * (back[:, 1:] - back[:, :1] * v)
        size = np.sqrt((v * v).sum(1, keepdims=True))
        w = np.sign(w) * np.maximum(np.abs(w) - cost, 0)
        v = v * np.maximum(1 - 2 * cost / np.maximum(size, 1e-12), 0)
        before, now = now, [b - 2 * g.sum(), w, v]
    b, w, v = now
    used = np.flatnonzero((w != 0) | v.any(1))
    used = used if len(used) else np.arange(1)
    return Machine({int(chosen[c]): i for i, c in enumerate(used)}, float(b[0] - mean @ w), w[used], v[used])


def train(docs: DataFrame, labels: DataFrame, limit: int = 12_000, longest: int = 8192) -> Machine:
    """Fitted on at most ``limit`` labelled rows with crc32(doc_id) mod 5 <> 0; their hashed terms are collected, of a text with
    more than ``longest`` of them those with the smallest hashes."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in batches:
            x = [np.sort(np.array(known.of(t), np.int32))[:longest].tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"].cast(pa.int32()), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    rows = map_arrow(labelled_sample(docs, labels, "toxic", 5, 0, limit), vectors, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit([(np.frombuffer(r["x"], np.int32), r["label"]) for r in rows])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1: score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Terms(model.kept)
        for batch in batches:
            score = model.scores([known.of(t) for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64()), pa.array(score >= 0.5, pa.bool_()).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    rows = map_arrow(docs.select("doc_id", "text"), add, "doc_id long, score double, predicted int")
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
