"""Quality classifier: Bradley-Terry pairwise ranking, thresholded at a quantile of the scores.

A document is described by the shares of its words' shapes (letters, capitals, digits and marks, runs collapsed) and
a few measures of repetition.  Each labelled document is in preference pairs (better, worse), which are drawn in blocks; a linear
score is fitted by logistic loss on the pairs' feature differences.  The cut is the quantile of the training scores, of all
labelled documents, that has the share of rejected labels below it; a logistic curve through it gives it a score of 0.7.

Defined cases: texts of any length are described as a whole; documents with equal features tie, with equal scores;  null and empty texts have a feature vector of their own (all zero but for its bias) and get a score;
without labels of both kinds every score is 0.7 (all documents pass); repeated rows get the same score; an empty table
gives an empty result; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.llm.common import Memory, fold, free, map_arrow, materialize, with_maybe

SHAPES, MEASURES = 256, 10
SIZE = SHAPES + MEASURES
CUT = 0.7
RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^\W\d_a-zA-Z]+|(.)\1*", re.S)


def shape(word: str) -> str:
    def kind(m: re.Match) -> str:
        c = m[0][0]
        return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else c

    return re.sub(r"a+", "a", re.sub(r"A+", "A", RUNS.sub(kind, word)))


#: The bucket of the shape of words of small letters.
SMALL = xxhash.xxh3_64_intdigest(b"a") % SHAPES


class Words(Memory):
    """word: (hash of the word) << 16 | letters? << 15 | capitals? << 14 | bucket of its shape."""

    def find(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 17
        if word.isascii() and word.isalpha() and word.islower():
            return h << 16 | 1 << 15 | SMALL
        letters = any(c.isalpha() for c in word)
        capitals = letters and word == word.upper() and sum(c.isalpha() for c in word) > 1
        bucket = xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass")) % SHAPES
        return h << 16 | letters << 15 | capitals << 14 | bucket


def features(text: str | None, words: Words) -> np.ndarray:
    out = np.zeros(SIZE, np.float32)
    out[SHAPES] = 1.0
    parts = (text or "").split()
    n = len(parts)
    if n:
        ids = np.fromiter(map(words.__getitem__, parts), np.int64, n)
        out[:SHAPES] = np.bincount(ids & (SHAPES - 1), minlength=SHAPES) / n
        lines = text.split("\n")
        distinct = len(np.unique(ids))
        out[SHAPES + 1 :] = (
            np.mean((ids >> 15) & 1), np.mean((ids >> 14) & 1), np.mean(ids[1:] == ids[:-1]) if n > 1 else 0.0, np.mean(ids[2:] == ids[:-2]) if n > 2 else 0.0,
            distinct / n, np.log(distinct + 1) / np.log(n + 1), len(set(lines)) / len(lines), min(1.0, len(text) / n / 20), min(1.0, np.log(n + 1) / 12),
        )
    return out


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights - self.cut) * self.slope + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def differences(block: int, better: np.ndarray, worse: np.ndarray, seed: int = 7) -> np.ndarray:
    """Feature differences of a block's pairs: two rounds, in each of which every row of the more common label meets one of
    the other, and those come equally often."""
    if not len(better) or not len(worse):
        return np.zeros((0, better.shape[1]))
    rng, n = np.random.default_rng([seed, block]), max(len(better), len(worse))
    i, j = (np.concatenate([np.resize(rng.permutation(len(x)), n) for _ in range(2)]) for x in (better, worse))
    return better[i].astype(np.float64) - worse[j]


def summed(pairs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The pairs' number, loss, gradient and second derivatives at ``w``, one after the other."""
    z = pairs @ w
    p = 1.0 / (1.0 + np.exp(np.clip(z, -30, 30)))
    return np.concatenate([[len(z), np.logaddexp(0, -z).sum()], -(p @ pairs), ((pairs * (p * (1 - p))[:, None]).T @ pairs).ravel()])


def descend(measure: Callable[[np.ndarray], np.ndarray], scale: np.ndarray, decay: float = 1e-4, steps: int = 12) -> np.ndarray:
    """Newton's method on the pairs' mean loss; ``measure`` gives the sums of ``summed`` over all pairs.  Features are scaled so that
    rare shapes count as much as common measures."""
    size = len(scale)
    w, back, best = np.zeros(size), np.zeros(size), np.inf
    for _ in range(steps):
        sums = measure(w * scale)
        n = sums[0]
        loss = sums[1] / n + decay / 2 * (w @ w)
        if loss > best:
            w = (w + back) / 2
            continue
        gain, best = best - loss, loss
        if gain < 1e-5:
            break
        gradient = sums[2 : size + 2] * scale / n + decay * w
        curve = sums[size + 2 :].reshape(size, size) * np.outer(scale, scale) / n + decay * np.eye(size)
        w, back = w - np.linalg.solve(curve, gradient), w
    else:
        w = back
    return w * scale


def scale_of(n: float, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return 1.0 / (np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)) + 0.01)


def curve_of(w: np.ndarray, low: float, high: float, cut: float) -> Ranker:
    """low, high: the mean scores of either label."""
    return Ranker(w, cut, float(8.0 / max(high - low, 1e-9)))


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """x: features, y: 0 or 1; what ``train`` does, for one block that is at hand."""
    better, worse = x[y == 1], x[y == 0]
    if not len(better) or not len(worse):
        return Ranker(np.zeros(x.shape[1] if x.ndim == 2 else SIZE), 0.0, 0.0)
    pairs = differences(0, better, worse)
    wide = x.astype(np.float64)
    w = descend(lambda w: summed(pairs, w), scale_of(len(x), wide.sum(0), (wide**2).sum(0)))
    s = np.sort(wide @ w)
    return curve_of(w, float((worse @ w).mean()), float((better @ w).mean()), float((s[len(worse) - 1] + s[len(worse)]) / 2))


def at_ranks(scores: DataFrame, ranks: list[int]) -> list[float]:
    """The scores (s) of these ranks, from 0 on: counted by bins between bounds, until what may be it are few values."""
    out = []
    for rank in ranks:
        low, high = scores.agg(F.min("s"), F.max("s")).first()
        rest = scores
        while True:
            bin_of = F.least(F.floor((F.col("s") - low) / max((high - low) / 65536, 5e-324)), F.lit(65535))
            counts = sorted(map(tuple, rest.groupBy(bin_of.alias("b")).agg(F.count("*"), F.min("s"), F.max("s")).collect())) if high > low else [(0, 1 << 62, low, high)]
            for _, n, low, high in counts:  # noqa: B007
                if rank < n:
                    break
                rank -= n
            if low == high or len(counts) == 1:
                out.append(low)
                break
            rest = rest.filter((F.col("s") >= low) & (F.col("s") <= high))
    return out


#: Rows of a block of pairs.
BLOCK = 4096


def vectors_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, x) of every labelled document with crc32(doc_id) mod 4 <> 2; a document with several labels counts with the
    smallest, one of which several rows have the id with that of the smallest hash.  Vectors, not texts, are shuffled."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id", 4) != 2))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label")).filter(F.col("label").isin(0, 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            x = [features(t, words).astype(np.float16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(x, pa.binary())], names=["doc_id", "mark", "x"])

    texts = with_maybe(docs.select("doc_id", "text"), known, "maybe").filter("maybe").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = map_arrow(texts, vectors, "doc_id long, mark long, x binary").join(known, "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct("mark", "x")).alias("m")).select("doc_id", "label", F.col("m.x").alias("x"))


def stacked(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float16).astype(np.float32).reshape(-1, SIZE)


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fitted on all labelled rows with crc32(doc_id) mod 4 <> 2.

    They are dealt into blocks by a hash of their id; where one label is rare, its rows are in so many blocks that each has some 512 of them
    or all.  Each pass sums over the blocks' pairs where they are; sums of fixed size, of at most 64 tasks, come to the driver.
    """
    rows = materialize(vectors_of(docs, labels), "quality-vectors")
    number = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(number) < 2:
        return Ranker(np.zeros(SIZE), 0.0, 0.0)
    blocks = -(-max(number.values()) // BLOCK)
    times = {label: min(blocks, -(-512 * blocks // n)) for label, n in number.items()}
    dealt = F.transform(F.sequence(F.lit(0), F.when(F.col("label") == 0, times[0] - 1).otherwise(times[1] - 1)), lambda k: F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) + k, F.lit(blocks)))
    each = rows.select(F.explode(dealt).alias("block"), "label", "doc_id", "x").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("label", "doc_id", "x"))).alias("rows"))
    side = lambda v: F.transform(F.filter("rows", lambda r: r["label"] == v), lambda r: r["x"])
    packed = materialize(each.select("block", side(1).alias("better"), side(0).alias("worse")), "quality-blocks")

    def over(table: DataFrame, act: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(x for batch in batches for x in act(batch))
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return sum(np.frombuffer(r["sums"]) for r in map_arrow(table.coalesce(64), rows, "sums binary").collect())

    def moments(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        x = stacked(batch["x"].to_pylist()).astype(np.float64)
        yield np.concatenate([x.sum(0), (x**2).sum(0)])

    def measure(w: np.ndarray) -> np.ndarray:
        def act(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for block, better, worse in zip(batch["block"].to_pylist(), batch["better"], batch["worse"]):
                yield summed(differences(block, stacked(better.as_py()), stacked(worse.as_py())), w)

        return over(packed, act)

    total = over(rows.select("x"), moments)
    w = descend(measure, scale_of(sum(number.values()), total[:SIZE], total[SIZE:]))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(stacked(batch["x"].to_pylist()).astype(np.float64) @ w)], names=["label", "s"])

    scored = materialize(map_arrow(rows.select("label", "x"), scores, "label int, s double"), "quality-scores")
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("s").alias("m")).collect()}
    # The quantile that leaves the rejected share below it, midway between its neighbours.
    return curve_of(w, means[0], means[1], sum(at_ranks(scored, [number[0] - 1, number[0]])) / 2)


def scored(docs: DataFrame, model: Ranker, names: list[str]) -> DataFrame:
    """``docs`` with score and predicted (1: score >= 0.7), by these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            x = np.array([features(t, words) for t in batch["text"].to_pylist()], np.float32).reshape(-1, SIZE)
            score = shared.value.score(x.astype(np.float64))
            columns = [*batch.columns, pa.array(score, pa.float64()), pa.array(score >= CUT, pa.bool_()).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return map_arrow(docs, add, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels), ["score", "predicted"])
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    names = free(docs, "_score", "_predicted")
    return scored(docs, train(docs, labels), names).filter(F.col(names[1]) == 1).select(*docs.columns)
