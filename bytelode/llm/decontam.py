"""Benchmark decontamination by greedy string tiling.

Words (lower-cased, without marks at their ends) that documents share with test items in runs of ``least`` are the
seeds.  For each document and item whose common seeds could cover enough of the item, running Karp-Rabin repeatedly finds the longest matches
between words that no tile covers yet, and marks them as tiles, longest first, down to runs of ``least`` words.  An item
is leaked if tiles cover a share of ``cover`` of its words, in whatever order they stand in the document.

The index of test items of up to ``PART`` words in all is broadcast. With more, the seeds are joined instead: a filter of
fixed size picks the documents' seeds that any item may have, these meet the items' seeds by an equi-join, and tiling is
run on the pairs that come of it.

Defined cases: texts and items of any length are searched as a whole; null and empty texts and items match nothing; an item with fewer words than ``least`` must stand in
the document as a whole; repeated rows get the same answer, repeated items are reported each; empty tables give
clean documents or an empty result; the other columns of documents pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.llm.common import WORD, free, map_arrow, materialize

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MARKS = ".,;:!?\"'()[]{}<>*#$%&|/\\~_-«»„“”‘’¿¡…"
PART = 2_000_000


class Tokens(dict):
    """word: the hash of what is left of it, 0 for nothing.  Emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = word.lower().strip(MARKS)
        out = self[word] = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1) if bare else 0
        return out

    def of(self, text: str | None) -> np.ndarray:
        parts = (text or "").split()
        a = np.fromiter(map(self.__getitem__, parts), U, len(parts))
        return a[a != 0]


def rolled(a: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens, modulo 2**64."""
    n = len(a) - size + 1
    if n <= 0:
        return np.empty(0, U)
    powers = np.cumprod(np.concatenate([[U(1)], np.full(len(a) - 1, BASE, U)]), dtype=U)
    sums = np.concatenate([[U(0)], np.cumsum(a * powers, dtype=U)])
    back = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, INVERSE, U)]), dtype=U)
    return (sums[size:] - sums[:-size]) * back


def tiling(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, words), non-overlapping on both sides, longest first."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(20, len(item), len(doc)))

    def whole(free: np.ndarray, size: int) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(c[size:] - c[:-size] == size)

    while True:
        found: list[tuple[int, int, int]] = []
        if size <= min(len(item), len(doc)):
            at_i, at_d = whole(free_i, size), whole(free_d, size)
            where: dict[int, list[int]] = {}
            for p, h in zip(at_d.tolist(), rolled(doc, size)[at_d].tolist()):
                where.setdefault(h, []).append(p)
            for p, h in zip(at_i.tolist(), rolled(item, size)[at_i].tolist()):
                for q in where.get(h, ()):
                    # Matches that can be extended to the left are found from there.
                    if p and q and free_i[p - 1] and free_d[q - 1] and item[p - 1] == doc[q - 1]:
                        continue
                    n = 0
                    while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n]:
                        n += 1
                    if n >= size:
                        found.append((n, p, q))
        longest = max(found, default=(0,))[0]
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for n, p, q in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_i[p : p + n].all() and free_d[q : q + n].all():
                free_i[p : p + n] = free_d[q : q + n] = False
                tiles.append((p, q, n))
            else:
                again = True  # a part of it may still be free
        if again:
            continue
        if size <= least:
            return tiles
        size = max(least, size // 2)


@dataclass(frozen=True)
class Index:
    """Items by place, with the hashes of their seeds by position; ``seeds`` by seed length: (hashes, first of items, items, mask), an
    item being listed with the seeds of which a document that leaks it must have one."""

    ids: list[int | None]
    items: list[np.ndarray]
    hashes: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def required(words: int, size: int, cover: float) -> int:
    """So many of an item's positions at least begin a seed within a tile, if tiles of ``size`` words or more cover the share."""
    return max(1, -(-max(1, ceil(cover * words - 1e-9)) // size))


def decisive(hashes: np.ndarray, words: int, size: int, cover: float, common: Counter) -> set[int]:
    """Seeds of which a leaking document has at least one: those at all positions but so many of the commonest ones."""
    order = sorted(hashes.tolist(), key=lambda h: (common[h], h))
    return set(order[: len(order) - required(words, size, cover) + 1])


def indexed(rows: list[tuple[int | None, str | None]], least: int, cover: float) -> Index:
    tokens = Tokens()
    items = [tokens.of(t) for _, t in rows]
    hashes = [rolled(item, min(least, len(item))) if len(item) else np.empty(0, U) for item in items]
    common = Counter(h for own in hashes for h in set(own.tolist()))
    lists: dict[int, list[tuple[int, int]]] = {}
    for at, item in enumerate(items):
        if size := min(least, len(item)):
            lists.setdefault(size, []).extend((h, at) for h in decisive(hashes[at], len(item), size, cover, common))
    seeds = {}
    for size, pairs in lists.items():
        pairs.sort()
        known, first = np.unique(np.array([h for h, _ in pairs], U), return_index=True)
        mask = np.zeros(1 << 16, bool)
        mask[(known & U(0xFFFF)).astype(np.int64)] = True
        seeds[size] = known, np.append(first, len(pairs)), np.array([at for _, at in pairs]), mask
    return Index([i for i, _ in rows], items, hashes, seeds)


def covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of so many words are in one of the stretches of ``size`` words that start there."""
    inside = np.zeros(length + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + size, -1)
    return np.cumsum(inside)[:length] > 0


def leaks(text: str | None, index: Index, tokens: Tokens, least: int, cover: float) -> list[dict]:
    """The items that the text leaks: item_id, coverage, tiles (item_start, doc_start, words), in words without marks."""
    doc = tokens.of(text)
    near: dict[int, set[int]] = {}
    rolls: dict[int, np.ndarray] = {}
    for size, (hashes, first, items, mask) in index.seeds.items():
        h = rolls[size] = rolled(doc, size)
        some = np.flatnonzero(mask[(h & U(0xFFFF)).astype(np.int64)])
        if len(some):
            at = np.searchsorted(hashes, h[some])
            at[at == len(hashes)] = 0
            for s in set(at[hashes[at] == h[some]].tolist()):
                near.setdefault(size, set()).update(items[first[s] : first[s + 1]].tolist())
    out = []
    for size, at in sorted((size, at) for size, found in near.items() for at in found):
        item, seeds = index.items[at], index.hashes[at]
        # Tiles can cover no more of the item than seeds that the document has; most pairs end here.
        if covered(np.flatnonzero(np.isin(seeds, rolls[size])), size, len(item)).sum() < cover * len(item) - 1e-9:
            continue
        # Only words in seeds can be in tiles; 0 stands for what is between them.
        keep = covered(np.flatnonzero(np.isin(rolls[size], seeds)), size, len(doc))
        edge = keep & ~np.concatenate([[False], keep[:-1]])
        where = np.flatnonzero(keep)
        order = np.insert(where, np.flatnonzero(edge[where]), -1)
        tiles = tiling(item, np.where(order < 0, U(0), doc[order]), size)
        coverage = sum(n for _, _, n in tiles) / len(item)
        if coverage >= cover:
            out.append((at, {"item_id": index.ids[at], "coverage": coverage, "tiles": [{"item_start": p, "doc_start": int(order[q]), "words": n} for p, q, n in tiles]}))
    return [found for _, found in sorted(out, key=lambda x: x[0])]


FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_start", "doc_start", "words")])))]))
ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([(n, pa.int64()) for n in ("item_start", "doc_start", "words")])))]))


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, cover: float = 0.5, part: int = PART, name: str = "_leaks") -> DataFrame:
    """``docs`` with the leaked items of each document, in a last column of that name."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    if (benchmark.agg(F.sum(words)).first()[0] or 0) > part:
        return joined_leaks(docs, benchmark, least, cover, name)
    rows = sorted(((r["item_id"], r["text"]) for r in benchmark.filter(words > 0).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    shared = docs.sparkSession.sparkContext.broadcast(indexed(rows, least, cover))
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tokens = shared.value, Tokens()
        for batch in batches:
            found = [leaks(t, index, tokens, least, cover) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, ARROW)], names=[*batch.schema.names, name])

    return map_arrow(docs, add, T.StructType([*docs.schema.fields, T.StructField(name, FOUND)]))


def joined_leaks(docs: DataFrame, benchmark: DataFrame, least: int, cover: float, name: str, bits: int = 26) -> DataFrame:
    """The same, for test items of any size: no table is on the driver or broadcast but a filter of ``2**bits`` bits."""
    spark = docs.sparkSession
    schema = "key long, id long, size int, seed long, pos int"

    def seeds(filtered):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = Tokens()
            chosen, sizes = filtered.value if filtered else (None, range(1, least + 1))
            for batch in batches:
                keys, ids, found, lengths, places = [], [], [], [], []
                for key, i, text in zip(*(batch[c].to_pylist() for c in ("key", "id", "text"))):
                    a = tokens.of(text)
                    for size in sizes if filtered else [min(least, len(a))]:
                        h = rolled(a, size) if size else np.empty(0, U)
                        if filtered:
                            h = np.unique(h)
                            spot = (h >> U(64 - bits)).astype(np.int64)
                            h = h[chosen[spot >> 6] >> (spot & 63).astype(U) & U(1) == 1]
                        found.append(h.view(np.int64))
                        keys += [key] * len(h)
                        ids += [i] * len(h)
                        lengths += [size] * len(h)
                        places += range(len(h))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(np.concatenate(found or [np.empty(0, np.int64)])), pa.array(places, pa.int32())], names=["key", "id", "size", "seed", "pos"])

        return rows

    key = F.xxhash64("text")
    items = benchmark.select(F.xxhash64("text").alias("item"), F.col("item_id"), F.col("text").alias("item_text"))
    # Items of one text are searched for once.  A document that leaks an item has, of the seeds at its positions, all but so many at
    # least; so one of those at the positions that are left without so many of the commonest ones.  These alone are joined: a
    # phrase that very many items have is among them only where an item has little else.
    single = items.select("item_text").distinct().select(F.xxhash64("item_text").alias("key"), F.lit(None).cast("long").alias("id"), F.col("item_text").alias("text"))
    every = materialize(map_arrow(single, seeds(None), schema), "item-seeds")
    common = every.groupBy("seed").agg(F.count_distinct("key").alias("common"))
    by_item = Window.partitionBy("key")
    ranked = every.join(common, "seed").withColumn("rank", F.row_number().over(by_item.orderBy("common", "seed", "pos"))).withColumn("n", F.count("*").over(by_item))
    need = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("size") - 1) * F.lit(cover) - 1e-9)) / F.col("size")))
    own = materialize(ranked.filter(F.col("rank") <= F.col("n") - need + 1).select("key", "size", "seed").distinct(), "item-decisive")
    spot = F.shiftrightunsigned("seed", 64 - bits)
    # At most 2**bits / 64 rows, whatever the items' number.
    words = own.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - bits}) & 63 AS INT)))").alias("b")).collect()
    chosen = np.zeros(1 << (bits - 6), np.int64)
    chosen[[r["w"] for r in words]] = [r["b"] for r in words]
    lengths = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most ``least``
    filtered = spark.sparkContext.broadcast((chosen.view(U), lengths))
    texts = docs.select(key.alias("key"), F.col("doc_id").alias("id"), "text")
    mine = map_arrow(texts, seeds(filtered), schema).join(own.select(F.col("key").alias("item"), "size", "seed"), ["size", "seed"])
    pairs = materialize(mine.select("key", "id", "item").distinct(), "leak-pairs")
    opened = pairs.join(items.dropDuplicates(["item"]).select("item", "item_text"), "item").join(texts.dropDuplicates(["key"]).select("key", "text"), "key")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            found = [leaks(t, indexed([(None, i)], least, cover), tokens, least, cover) for t, i in zip(batch["text"].to_pylist(), batch["item_text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["id"], batch["item"], pa.array([f[0]["coverage"] if f else None for f in found], pa.float64()), pa.array([f[0]["tiles"] if f else None for f in found], ARROW.value_type.field("tiles").type)], names=["key", "id", "item", "coverage", "tiles"])

    tiled = map_arrow(opened.select("key", "id", "item", "item_text", "text"), tile, T.StructType([T.StructField(n, T.LongType()) for n in ("key", "id", "item")] + FOUND.elementType.fields[1:]))
    hits = tiled.filter(F.col("coverage").isNotNull()).join(items.select("item", "item_id"), "item")
    each = hits.groupBy("key", "id").agg(F.collect_list(F.struct("item_id", "coverage", "tiles")).alias("hits"))
    # Repeated rows of one id and text have met once each.
    each = materialize(each, "leaks")
    k, i, h = free(docs, "_key", "_id", "_hits")
    each = each.select(F.col("key").alias(k), F.col("id").alias(i), F.col("hits").alias(h))
    out = docs.join(each, (F.xxhash64(docs["text"]) == each[k]) & docs["doc_id"].eqNullSafe(each[i]), "left")
    return out.select(*docs.columns, F.coalesce(h, F.array().cast(FOUND)).alias(name))


def report(docs: DataFrame, benchmark: DataFrame, least: int = 5, cover: float = 0.5) -> DataFrame:
    """doc_id, contaminated, coverage (the highest of a leaked item, else 0), item_ids (leaked, in order), for each row."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, least, cover)
    return found.select("doc_id", (F.size("_leaks") > 0).alias("contaminated"), F.coalesce(F.array_max("_leaks.coverage"), F.lit(0.0)).alias("coverage"), F.array_sort("_leaks.item_id").alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, cover: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    (name,) = free(docs, "_leaks")
    return with_leaks(docs, benchmark, least, cover, name=name).filter(F.size(name) == 0).select(*docs.columns)
