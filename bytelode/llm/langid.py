"""Language identification by cross-parsing entropy.

For each language, a suffix automaton is built of labelled text.  A document is parsed against each automaton into
longest matches: a phrase ends where the automaton has no step for the next symbol.  The language whose text lets the
document be parsed into the fewest phrases for its length wins.

Symbols are lower-cased letters, all that the training text has; whatever stands between letters counts as one blank.  A
language's automaton has steps for its own letters only.  Automata are transition tables, or sorted lists of steps where
tables would be large (many languages or letters), and many pieces of text walk through a table at once: texts are cut into pieces of ``PIECE`` symbols, and a phrase ends
at a piece's end, for all languages alike.

Defined cases: ``und`` with score 0 if a text is null or has no letter, or if there is nothing to learn from;
of languages that need equally many phrases, the first in order wins; a null lang is not learned; repeated rows
get the same answer; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import fold, map_arrow

PIECE = 512
BLANK, OTHER = 1, 0


def suffixes(symbols: np.ndarray) -> list[dict[int, int]]:
    """For each state of the suffix automaton its steps, symbol: state.  State 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        now = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = now
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return steps


def automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton; -1: none."""
    return Steps.of(suffixes(symbols), alphabet).table()


@dataclass(frozen=True)
class Steps:
    """Steps of an automaton: keys, which are state * width + symbol, in order, and the states that they lead to."""

    width: int
    states: int
    keys: np.ndarray
    to: np.ndarray

    @staticmethod
    def of(steps: list[dict[int, int]], width: int) -> Steps:
        n = sum(map(len, steps))
        keys = np.fromiter((state * width + c for state, step in enumerate(steps) for c in step), np.int64, n)
        to = np.fromiter((to for step in steps for to in step.values()), np.int32, n)
        order = np.argsort(keys)
        return Steps(width, len(steps), keys[order], to[order])

    def table(self) -> np.ndarray:
        out = np.full(self.states * self.width, -1, np.int32)
        out[self.keys] = self.to
        return out.reshape(self.states, self.width)

    def start(self) -> np.ndarray:
        out = np.full(self.width, -1, np.int32)
        n = np.searchsorted(self.keys, self.width)
        out[self.keys[:n]] = self.to[:n]
        return out

    def after(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.to[at], -1)


@dataclass(frozen=True)
class Parser:
    """letters: code points of the alphabet, from symbol 2 on.  By language, in order: own, the symbols that its text has,
    which are 1, 2, ... in its automaton; steps: the automaton."""

    letters: np.ndarray
    languages: list[str]
    own: list[np.ndarray]
    steps: list[Steps]

    def lookup(self) -> np.ndarray:
        """The symbol of each code point: a blank for what is no letter, OTHER for letters not seen in training."""
        table = np.zeros(0x110000, np.int32)
        for start in range(0, 0x110000, 0x1000):
            table[start : start + 0x1000] = [OTHER if chr(c).isalpha() else BLANK for c in range(start, start + 0x1000)]
        table[self.letters] = np.arange(2, 2 + len(self.letters))
        return table

    def tables(self, most: int = 64 << 20) -> list[np.ndarray | Steps]:
        """The automata, as tables as long as all of them have at most so many bytes."""
        out: list[np.ndarray | Steps] = []
        for steps in self.steps:
            size = 4 * steps.states * steps.width
            out.append(steps.table() if size <= most else steps)
            most -= size if size <= most else 0
        return out


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str | None, lookup: np.ndarray) -> np.ndarray:
    s = lookup[code_points(text)]
    if len(s):
        blank = s == BLANK
        s = s[~(blank & np.concatenate([[True], blank[:-1]]))]
    return s


def phrases(pieces: list[np.ndarray], table: np.ndarray | Steps) -> np.ndarray:
    """The number of phrases of each piece; pieces in order of falling length."""
    return counted(*side_by_side(pieces), table)


def side_by_side(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as columns, and how many pieces are longer than t."""
    lengths = np.array([len(p) for p in pieces])
    lanes = np.zeros((int(lengths[0]), len(pieces)), np.int32)
    for i, p in enumerate(pieces):
        lanes[: len(p), i] = p
    return lanes, np.searchsorted(-lengths, -np.arange(lengths[0]), "left")


def counted(lanes: np.ndarray, alive: np.ndarray, table: np.ndarray | Steps) -> np.ndarray:
    if isinstance(table, Steps):
        width, start, after = np.int64(table.width), table.start(), table.after
    else:
        width, start, after = np.int64(table.shape[1]), table[0], table.ravel().__getitem__
    count, state = np.zeros(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
    for t, n in enumerate(alive):
        c, at = lanes[t, :n], state[:n]
        to = after(at * width + c)
        # A phrase begins at the start, after a symbol that the language lacks, and where there is no step.
        ends = np.flatnonzero(to < 0)
        count[:n] += (to < 0) | (at == 0)
        to[ends] = np.maximum(start[c[ends]], 0)
        state[:n] = to
    return count


def predicted(texts: list[str | None], parser: Parser, lookup: np.ndarray, tables: list[np.ndarray | Steps]) -> tuple[list[str], list[float]]:
    found = [symbols(t, lookup) for t in texts]
    pieces, owner = [], []
    for i, s in enumerate(found):
        if len(s) and (s != BLANK).any():
            for at in range(0, len(s), PIECE):
                pieces.append(s[at : at + PIECE])
                owner.append(i)
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not pieces or not parser.languages:
        return names, scores
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    pieces, owners = [pieces[i] for i in order], np.array([owner[i] for i in order])
    counts = np.zeros((len(parser.languages), len(texts)))
    # So many lanes at a time that their states stay in the cache.
    for at in range(0, len(pieces), 4096):
        lanes, alive = side_by_side(pieces[at : at + 4096])
        for a, (own, table) in enumerate(zip(parser.own, tables)):
            place = np.zeros(2 + len(parser.letters), np.int32)
            place[own] = np.arange(1, 1 + len(own))
            np.add.at(counts[a], owners[at : at + 4096], counted(place[lanes], alive, table))
    for i in np.unique(owners):
        rate = counts[:, i] / len(found[i])
        best = int(rate.argmin())
        # Shares of the languages, for a difference in phrases that grows with the text's length.
        gap = (rate - rate[best]) * min(len(found[i]), 400)
        names[i], scores[i] = parser.languages[best], float(1.0 / np.exp(-np.minimum(gap, 50)).sum())
    return names, scores


def train(docs: DataFrame, rows: int = 100, longest: int = 5000, size: int = 40_000) -> Parser:
    """Learned from a bounded sample of documents with crc32(doc_id) mod 5 <> 0.

    Of each language, about ``rows`` documents are drawn by a hash of the id, of each its first ``longest`` characters from
    the first letter on, and of these as many as fit into ``size`` symbols; the alphabet is all letters of the sample.
    """
    known = docs.select("lang", "doc_id", "text").filter(F.col("lang").isNotNull() & (fold("doc_id", 5) != 0)).filter(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    piece = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, longest).alias("text")
    drawn = known.join(F.broadcast(counts), "lang").filter(draw < rows / F.col("n")).select("lang", "doc_id", piece)
    # Rows of one id are drawn together: one text of them is enough.
    sample = drawn.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    values = sorted({c for v in texts.values() for t in v for c in t.lower() if c.isalpha()})
    parser = Parser(np.array([ord(c) for c in values], np.int64), sorted(texts), [], [])
    lookup = parser.lookup()
    for lang in parser.languages:
        joined, free = [], size
        for s in (symbols(t, lookup) for t in texts[lang]):
            if len(s) < free:
                joined += [s, np.array([BLANK], np.int32)]
                free -= len(s) + 1
        own, text = np.unique(np.concatenate(joined or [np.array([BLANK], np.int32)]), return_inverse=True)
        parser.own.append(own)
        parser.steps.append(Steps.of(suffixes(text + 1), len(own) + 1))
    return parser


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, tables = shared.value.lookup(), shared.value.tables()
        for batch in batches:
            names, scores = predicted(batch["text"].to_pylist(), shared.value, lookup, tables)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = map_arrow(docs.select("doc_id", "text"), add, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
