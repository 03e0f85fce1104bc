"""N-gram Jaccard join: an exact, blocked sparse product of documents by n-grams.

Documents with the same set of shingles form a class; classes are joined, copies never are.  Shingles are ordered
by how common they are (a sketch of fixed size counts them over all documents; any order gives right results, this one
short lists).  Two sets that reach the threshold share at least ``l`` of their first ``n - ceil(t * n) + l`` shingles in
that order, so only these prefixes enter the first product, and a class that shares fewer than ``l`` of its own with
anybody is out.  For what is left, the members of each prefix shingle's list meet in blocks.  A pair is handled in the
block of the first shingle it has in common, if sizes and positions still allow the threshold; there the sparse product of
the full sets accumulates overlaps.  Lists longer than a block are dealt over tiles.  A block returns a spanning forest of its
links and each member's number of linked documents, so nothing that leaves it is larger than the block.

Defined cases: texts of any length are compared as a whole; null texts and texts without words have no shingles and no links, and are components of their own, as
are rows with a null doc_id (their component_id is null); fewer words than ``n`` are one shingle; rows that share a
doc_id are rows of their own, with equal texts linked as any copies; an empty table gives an empty result; columns
besides ``doc_id`` and ``text`` are not read.  Shingles are compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelode.llm.common import concluded, free, map_arrow, materialize, with_maybe, without

U = np.uint64
MIX = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]


@dataclass(frozen=True)
class Join:
    """n: words of a shingle.  percent: of the union that the intersection must reach.  sketch: bits of the counters'
    address.  block: members of a list that meet in one tile."""

    n: int = 3
    percent: int = 90
    sketch: int = 20
    block: int = 512

    def need(self, size: np.ndarray | int):
        """The smallest overlap that a set of this size can reach the threshold with."""
        return -(-self.percent * size // 100)

    def least(self, size: int) -> int:
        """How many shingles of two prefixes must be shared; grows with the size, so longer sets need more evidence."""
        return max(1, size // 20)


class Hashes(dict):
    """word: its hash.  Emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, n: int, words: Hashes) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, U)
    if len(parts) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=1)], U)
    a = np.fromiter(map(words.__getitem__, parts), U, len(parts))
    h = a[: len(a) - n + 1].copy()
    for i in range(1, n):
        h ^= h >> U(32)
        h *= MIX[i % 2]
        h += a[i : len(a) - n + 1 + i]
    h ^= h >> U(29)
    h *= MIX[0]
    h ^= h >> U(32)
    return np.unique(h)


def fingerprint(s: np.ndarray, width: int = 16) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())[:width]


COUNTED = ["doc_id", "mark", "n", "fp", "part", "counts"]


def counted(join: Join):
    """For each document (doc_id, mark, n, fp), and at the end of a task its counters, in parts: (part, counts)."""
    parts, width = 16, (1 << join.sketch) // 16

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, seen = Hashes(), np.zeros(1 << join.sketch, np.uint32), set()
        for batch in batches:
            sizes, prints = [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, join.n, words)
                sizes.append(len(s))
                prints.append(fp := fingerprint(s) if len(s) else None)
                if fp is not None and fp not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(fp)
                    np.add.at(counts, (s >> U(64 - join.sketch)).astype(np.int64), 1)
            nothing = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), *nothing], names=COUNTED)
        for p in range(parts):
            own = counts[p * width : (p + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([p], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=COUNTED)

    return rows


def summed(key: tuple, part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counters of a part over all tasks, as steps of a quarter power of two, a byte each."""
    total = None
    for pdf in part:
        for raw in pdf["counts"]:
            x = np.frombuffer(raw, np.uint32).astype(np.uint64)
            total = x if total is None else total + x
    yield pd.DataFrame({"part": [key[0]], "levels": [np.minimum(np.log2(np.maximum(total, 1)) * 4, 255).astype(np.uint8).tobytes()]})


def ordered(s: np.ndarray, levels: np.ndarray, join: Join) -> np.ndarray:
    """The set's prefix in the global order: rare first, then by hash."""
    size = len(s)
    take = min(size, size - join.need(size) + join.least(size))
    rank = levels[(s >> U(64 - join.sketch)).astype(np.int64)]
    if take < size:
        cut = np.partition(rank, take - 1)[take - 1]
        at = np.flatnonzero(rank <= cut)
        return s[at[np.lexsort((s[at], rank[at]))[:take]]]
    return s[np.lexsort((s, rank))]


def prefixes(join: Join, levels, width: int):
    """(g, fp, n, pos) for the prefix of each class, once in each task that meets it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, order = Hashes(), set(), levels.value
        for batch in batches:
            gs, fps, ns, ps = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, join.n, words)
                if not len(s) or (fp := fingerprint(s, width)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                p = ordered(s, order, join)
                gs.append(p)
                fps += [fp] * len(p)
                ns.append(np.full(len(p), len(s)))
                ps.append(np.arange(len(p)))
            if gs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gs).view(np.int64)), pa.array(fps, pa.binary()), pa.array(np.concatenate(ns), pa.int64()), pa.array(np.concatenate(ps), pa.int32())], names=["g", "fp", "n", "pos"])

    return rows


MEMBER = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("fp", pa.binary()), ("n", pa.int64()), ("pos", pa.int32()), ("before", pa.binary())])
LINK = pa.schema([("fp", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])


PLACE = pa.schema(list(MEMBER)[:-1])


def flush(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)


def places(join: Join):
    """For each live class, a row for each list and tile it is in: (g, i, j, own, fp, n, pos)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for fp, n, shared in zip(batch["fp"].to_pylist(), batch["n"].to_pylist(), batch["shared"]):
                # The first shingle that a pair shares comes early enough for the rest to reach the threshold.
                last = n - join.need(n)
                for x in shared.as_py():
                    if x["pos"] <= last:
                        tiles = -(-x["m"] // join.block)
                        own = int.from_bytes(fp[:4], "little") % tiles
                        out += [(x["g"], min(own, t), max(own, t), own, fp, n, x["pos"]) for t in range(tiles)]
                if len(out) > 50_000:
                    yield flush(out, PLACE)
                    out = []
            yield flush(out, PLACE)

    return rows


def fitting(join: Join):
    """The rows of a tile that have a partner of fitting size and position."""

    def act(key: tuple, rows: list[tuple]) -> list[tuple]:
        n, pos, own = (np.array([r[c] for r in rows]) for c in (5, 6, 3))
        ok = candidates(n, pos, [], own, key[1] != key[2], join)
        return [rows[x] for x in np.flatnonzero(ok.any(0) | ok.any(1))]

    return by_group(PLACE.names, act, PLACE)


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, n, shared, tiles) to MEMBER: a class's rows, each with the shared shingles that come before it."""
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for fp, n, shared, tiles in zip(batch["fp"].to_pylist(), batch["n"].to_pylist(), batch["shared"], batch["tiles"]):
            shared = sorted(shared.as_py(), key=lambda x: x["pos"])
            g = np.array([x["g"] for x in shared], np.int64)
            at = {x["g"]: k for k, x in enumerate(shared)}
            for t in tiles.as_py():
                before = g[: at[t["g"]]].tobytes()
                out.append((t["g"], t["i"], t["j"], t["own"], fp, n, t["pos"], before))
                held += len(before) + 100
            if held > 4 << 20:
                yield flush(out, MEMBER)
                out, held = [], 0
    yield flush(out, MEMBER)


def products(sets: list[np.ndarray], width: int = 4096, part: int = 1 << 20) -> np.ndarray:
    """Overlap sizes of all members' sets: a sparse product, summed over ranges of values of about ``part`` entries, and in
    these over blocks of ``width`` columns; only values that at least two members hold are columns."""
    total = np.zeros((len(sets), len(sets)), np.float32)
    sets = [s.view(U) for s in sets]
    bounds = np.linspace(0, 2.0**64, sum(map(len, sets)) // part + 2)[1:-1].astype(U)
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]).astype(np.int64) for s in sets]
    for b in range(len(bounds) + 1):
        parts = [s[c[b] : c[b + 1]] for s, c in zip(sets, cuts)]
        values, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        place = np.full(len(values), -1)
        common = np.flatnonzero(count >= 2)
        place[common] = np.arange(len(common))
        rows, cols = np.repeat(np.arange(len(sets)), [len(s) for s in parts]), place[at]
        rows, cols = rows[cols >= 0], cols[cols >= 0]
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        for first in range(0, len(common), width):
            low, high = np.searchsorted(cols, [first, first + width])
            x = np.zeros((len(sets), min(width, len(common) - first)), np.float32)
            x[rows[low:high], cols[low:high] - first] = 1
            total += x @ x.T
    return total


def candidates(n: np.ndarray, pos: np.ndarray, before: list[np.ndarray], own: np.ndarray, cross: bool, join: Join) -> np.ndarray:
    """Pairs (a < b by place) that meet here for the first time and may still reach the threshold; a boolean matrix."""
    # 100 * o >= percent * (a + b - o)
    need = -(-join.percent * (n[:, None] + n[None, :]) // (100 + join.percent))
    rest = np.minimum((n - pos)[:, None], (n - pos)[None, :])
    ok = (np.minimum(n[:, None], n[None, :]) >= need) & (rest >= need) & np.triu(np.ones((len(n), len(n)), bool), 1)
    if cross:
        ok &= own[:, None] != own[None, :]
    if ok.any() and any(len(x) for x in before):
        ok &= products([np.sort(x.view(U)) for x in before]) == 0
    return ok


def by_group(names: list[str], act, schema: pa.Schema):
    """Runs ``act(key, rows)`` for each run of rows with the same (g, i, j), in a stream: only one group is held."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch[name].to_pylist() for name in names)):
                if row[:3] != key:
                    if len(held) > 1:
                        out += act(key, held)
                    key, held = row[:3], []
                    if len(out) > 2000:
                        yield flush(out, schema)
                        out = []
                held.append(row)
        if len(held) > 1:
            out += act(key, held)
        yield flush(out, schema)

    return rows


def pairs_of(key: tuple, rows: list[tuple], join: Join) -> np.ndarray | list[tuple[int, int]]:
    """Places (a, b) of the pairs to check; rows: (g, i, j, own, fp, n, pos, before, ...) in order of fp."""
    if len(rows) > 12:
        n, pos, own = (np.array([r[c] for r in rows]) for c in (5, 6, 3))
        return np.argwhere(candidates(n, pos, [np.frombuffer(r[7], np.int64) for r in rows], own, key[1] != key[2], join))
    found, cross, earlier = [], key[1] != key[2], {}
    for b in range(1, len(rows)):
        for a in range(b):
            x, y = rows[a], rows[b]
            need = -(-join.percent * (x[5] + y[5]) // (100 + join.percent))
            if min(x[5], y[5]) < need or min(x[5] - x[6], y[5] - y[6]) < need or cross and x[3] == y[3]:
                continue
            for r in (a, b):
                if r not in earlier:
                    earlier[r] = set(np.frombuffer(rows[r][7], np.int64).tolist())
            if earlier[a].isdisjoint(earlier[b]):
                found.append((a, b))
    return found


def met(join: Join):
    """The members of a list that have a pair to check, as they came."""

    def act(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [rows[x] for x in sorted({int(x) for pair in pairs_of(key, rows, join) for x in pair})]

    return by_group(MEMBER.names, act, MEMBER)


def verified(join: Join):
    """(fp, other, null): links that span the group's linked members; (fp, null, n): a member's linked documents."""

    def act(key: tuple, rows: list[tuple]) -> list[tuple]:
        pairs = np.array(pairs_of(key, rows, join), np.int64).reshape(-1, 2)
        if not len(pairs):
            return []
        sets = [np.frombuffer(r[9], U) for r in rows]
        n, copies = np.array([r[5] for r in rows]), np.array([r[8] for r in rows])
        a, b = pairs.T
        if len(rows) > 12:
            o = products(sets)[a, b].astype(np.int64)
        else:
            o = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs], np.int64)
        hit = 100 * o >= join.percent * (n[a] + n[b] - o)
        a, b = a[hit], b[hit]
        near = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = [(rows[x][4], None, int(near[x])) for x in np.flatnonzero(near)]
        for x, y in zip(a.tolist(), b.tolist()):
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((rows[x][4], rows[y][4], None))
        return out

    return by_group([*MEMBER.names, "copies", "hashes"], act, LINK)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b): alternating large and small stars until nothing changes.

    Every round ends in a written table; what is looked at on the driver is its number of rows and sums of their hashes.
    """
    last = None
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        every = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = every.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = materialize(small, "cc")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        same, last = mark == last, mark
        if same:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after


def meeting(lists: DataFrame, join: Join) -> DataFrame:
    """``lists`` (g, fp, n, pos) with m, the length of a row's list; without the rows that have nobody of fitting size in their list.

    Of a list in order of size, the one before or after fits if any does.
    """
    order = Window.partitionBy("g").orderBy("n")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lists.select("g", "fp", "n", "pos", F.count("*").over(whole).alias("m"), F.lag("n").over(order).alias("lower"), F.lead("n").over(order).alias("upper"))
    return rows.filter((100 * F.col("lower") >= join.percent * F.col("n")) | (100 * F.col("n") >= join.percent * F.col("upper"))).drop("lower", "upper")


def enough(shared: DataFrame, join: Join) -> DataFrame:
    """(fp, n, shared) of the classes that share enough: at least what the smallest possible partner's prefix was drawn for."""
    live = shared.groupBy("fp").agg(F.first("n").alias("n"), F.collect_list(F.struct("pos", "g", "m")).alias("shared"))
    return live.filter(F.size("shared") >= F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * join.percent + 99) / 100) / 20)))


def classes_and_links(docs: DataFrame, join: Join = Join(), among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, mark, n, fp), links (fp, other, links)); mark: a hash of the text; see ``verified``.

    among: a table of the doc_id that count, if not all do.  Texts are neither joined with it nor written: a filter of fixed size
    lets out most others, and the rest of these go from the sets and the lists.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    if among is not None:
        texts = with_maybe(texts, among, "maybe").filter("maybe").select("doc_id", "text")
    marked = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    first = materialize(map_arrow(marked, counted(join), "doc_id long, mark long, n long, fp binary, part int, counts binary"), "join-sets")
    sets = first.filter(F.col("part").isNull()).select("doc_id", "mark", "n", "fp")
    parts = first.filter(F.col("part").isNotNull()).groupBy("part").applyInPandas(summed, "part int, levels binary").collect()
    levels = np.zeros((16, (1 << join.sketch) // 16), np.uint8)
    for r in parts:
        levels[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    order = spark.sparkContext.broadcast(levels.ravel())
    # Lists of prefix shingles; a class met by several tasks is there once.
    # Classes are named by 64 bits of their hash where that tells all of them apart (those that do not count, too), as it does below a billion or so.
    names = sets.filter(F.col("fp").isNotNull()).select("fp").distinct().groupBy(F.substring("fp", 1, 8).alias("short")).count().filter("count > 1")
    width = 8 if names.isEmpty() else 16
    sets = sets.withColumn("fp", F.substring("fp", 1, width))
    if among is not None:
        sets = materialize(sets.join(among, "doc_id", "left_semi"), "join-among")
    return sets, concluded(spark, lambda: links_of(texts, sets, order, width, join, among is not None), "join-links")


def links_of(texts: DataFrame, sets: DataFrame, order, width: int, join: Join, others: bool) -> DataFrame:
    """(fp, other, links) of the classes of ``sets``; order: the broadcast steps of the counters; width: bytes of a class's name; others:
    whether ``texts`` may have other classes too."""
    lists = map_arrow(texts, prefixes(join, order, width), "g long, fp binary, n long, pos int").repartition("g").dropDuplicates(["g", "fp"])
    shared = meeting(lists, join)
    # Twice: lists get shorter by the classes that are out, and with them more classes are.
    for again in (True, False):
        live = enough(shared, join)
        if again and others:
            live = live.join(sets.select("fp").distinct(), "fp", "left_semi")
        live = materialize(live, "join-live")
        if again:
            shared = meeting(live.select("fp", "n", F.inline("shared")).select("g", "fp", "n", "pos"), join)
    fields = "g long, i int, j int, own int, fp binary, n long, pos int, before binary"
    together = ["g", "i", "j", "fp"]
    light = map_arrow(live, places(join), "g long, i int, j int, own int, fp binary, n long, pos int").repartition("g", "i", "j").sortWithinPartitions(*together)
    fits = light.mapInArrow(fitting(join), "g long, i int, j int, own int, fp binary, n long, pos int")
    tiles = materialize(fits.groupBy("fp").agg(F.collect_list(F.struct("g", "i", "j", "own", "pos")).alias("tiles")), "join-tiles")
    full_rows = map_arrow(live.join(tiles, "fp").select("fp", "n", "shared", "tiles"), entries, fields).repartition("g", "i", "j").sortWithinPartitions(*together)
    pairs = materialize(full_rows.mapInArrow(met(join), fields), "join-pairs")
    # Full sets, only of the classes that are in a pair: their documents are picked by a filter of fixed size first.
    in_pair = pairs.select("fp").distinct()
    of_class = sets.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    wanted = materialize(in_pair.join(of_class, "fp"), "join-wanted")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [shingles(t, join.n, hashes) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([fingerprint(s, width) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "fp", "hashes"])

    picked = with_maybe(texts, wanted, "maybe").filter("maybe").select("doc_id", "text")
    whole = map_arrow(picked, full, "doc_id long, fp binary, hashes binary")
    whole = whole.join(wanted, ["fp", "doc_id"]).dropDuplicates(["fp"]).select("fp", "copies", "hashes")
    blocks = pairs.join(whole, "fp").repartition("g", "i", "j").sortWithinPartitions(*together)
    return blocks.mapInArrow(verified(join), "fp binary, other binary, links long")


def grouped(docs: DataFrame, join: Join, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, mark, n, fp), classes (fp, component_id, n_links) of more than one document or with links)."""
    sets, links = classes_and_links(docs, join, among)
    return sets, concluded(docs.sparkSession, lambda: classes_of(sets, links), "join-classes")


def classes_of(sets: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links.filter(F.col("other").isNotNull()).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    near = links.filter(F.col("other").isNull()).groupBy("fp").agg(F.sum("links").alias("near"))
    # By class, so that a class with very many copies is one row in the joins; classes of one document without links need none.
    classes = sets.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    classes = materialize(classes.join(near, "fp", "left").filter((F.col("copies") > 1) | F.col("near").isNotNull()), "join-some")
    classes = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return classes.join(lows, "root").select("fp", "component_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (documents linked directly)."""
    sets, classes = grouped(docs, join)
    alone = F.coalesce("component_id", "doc_id")
    return (
        sets.join(classes, "fp", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    )


NEAR = Join(n=5, percent=80)


def surplus(docs: DataFrame, join: Join, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, mark, one) of the rows that are not their group's representative, which is the row with the smallest doc_id, and
    of these the smallest hash of its text; ``one``: copies of the representative's row itself, of which one stays.  Only rows whose
    doc_id is ``among`` these are looked at, if it is given."""
    return concluded(docs.sparkSession, lambda: surplus_of(*grouped(docs, join, among)), "join-surplus")


def surplus_of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    members = sets.filter(F.col("doc_id").isNotNull()).join(classes.select("fp", "component_id"), "fp").groupBy("doc_id", "mark", "component_id").agg(F.count("*").alias("rows"))
    first = members.filter(F.col("doc_id") == F.col("component_id")).groupBy("component_id").agg(F.min("mark").alias("first"))
    chosen = (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("first"))
    found = members.join(first, "component_id").select("doc_id", "mark", chosen.alias("one"), "rows")
    return found.filter(~F.col("one") | (F.col("rows") > 1)).select("doc_id", "mark", "one")


def representatives(docs: DataFrame, join: Join = NEAR) -> DataFrame:
    """``docs`` with one row of each group.  Rows are told apart by doc_id and a hash of their text; those without an id stay."""
    gone = surplus(docs, join)
    (key,) = free(docs, "_row")
    rows = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text")))
    of = lambda test: gone.filter(test).select(F.xxhash64("doc_id", "mark").alias(key))
    kept = without(rows, of(~F.col("one")), key)
    again = of("one")
    if not again.isEmpty():
        (maybe,) = free(kept, "_maybe")
        marked = with_maybe(kept, again, maybe, key)
        copies = marked.filter(F.col(maybe)).drop(maybe)
        some = copies.join(again, key, "left_semi").dropDuplicates([key])
        kept = marked.filter(~F.col(maybe)).drop(maybe).unionByName(copies.join(again, key, "left_anti")).unionByName(some)
    return kept.select(*docs.columns)


def left_of(text: str | None, before: str | None) -> bool:
    """Whether the text's lines are lines of what it was before, in their order."""
    rest = iter((before or "").split("\n"))
    return not text or all(line in rest for line in text.split("\n"))


def without_copies(docs: DataFrame, before: DataFrame, join: Join = NEAR) -> DataFrame:
    """``docs`` without those that were near copies of a document that stays, as they were ``before`` (doc_id, text) their repeated
    lines went.

    Documents are compared as they were; one of each group stays.  Only documents whose lines are lines of what they were can
    go, and only those are taken as copies of each other that are in both tables.
    """

    def were() -> DataFrame:
        ids = materialize(docs.select("doc_id").filter(F.col("doc_id").isNotNull()), "join-ids")
        return surplus(before, join, ids).filter(~F.col("one")).select("doc_id").distinct()

    gone = concluded(docs.sparkSession, were, "join-gone")
    mine = with_maybe(docs.select("doc_id", "text"), gone, "maybe").filter("maybe").select("doc_id", "text").join(gone, "doc_id", "left_semi")
    theirs = with_maybe(before.select("doc_id", F.col("text").alias("before")), gone, "maybe").filter("maybe").select("doc_id", "before")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [left_of(a, b) for a, b in zip(batch["text"].to_pylist(), batch["before"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].filter(pa.array(good, pa.bool_()))], names=["doc_id"])

    sure = materialize(map_arrow(mine.join(theirs, "doc_id").select("doc_id", "text", "before"), check, "doc_id long").distinct(), "join-copies")
    return without(docs, sure)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS g FROM w
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) l ON l.a = d.doc_id
"""
