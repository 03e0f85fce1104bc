"""Exact top-k search by inner product, with pivot-table elimination.

Vectors are turned into integers.  Those of one length are a group, or two: wide ones, whose products need more than 64
bits, are kept apart.  In a group each vector gets one more coordinate that makes all norms equal; then the larger the inner
product with a query, the smaller the Euclidean distance.  Distances of every vector to a number of pivots are computed once;
by the triangle inequality the largest difference of two vectors' distances to a pivot is a lower bound of theirs.

Vectors are dealt into blocks by their two nearest pivots, and of each block the range of distances to every pivot is kept.  A
query first meets a share of the block of its own nearest pivots, which gives a score that its k-th best has at least; it then
goes only to the blocks that may hold a better one.  In a block, a query's candidates are evaluated in order of their bounds until no
bound left could still reach its k-th score; scores are exact integers.  The best of all blocks are merged.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with
a null id; vectors of another length than the query's are no candidates of it; rows are what is searched, so that a repeated row or
id is a query, and a candidate, of its own, and only the query's own row is left out; ties go to the smaller id; an empty table
gives an empty result; further columns are not touched, whatever their names; components have no limit, but a score
among the k best that does not fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelode.llm.common import map_arrow, materialize

#: Components of narrow vectors, and their squared norms, are at most so large: products are below 2**62 then.
COMPONENT, NORM = float(1 << 30), float(1 << 62)
LONG = 1 << 63
ROWS = "row long, vec_id long, dim int, wide boolean, norm double, vec binary"
PLACED = f"{ROWS}, grp long, far binary, cell int"
FOUND = "row long, query_id long, vec_id long, score long, over boolean, evaluated long"


def quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to ROWS.  ``vec``: int32 of narrow vectors, float64 of wide ones as they came."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for i, vector in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist()):
            row += 1
            if i is None or not vector or None in vector:
                continue
            raw = np.asarray(vector, np.float64)
            if not np.isfinite(raw).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(256.0 * raw)
                norm = float(x @ x)
            wide = not (np.abs(x).max() <= COMPONENT and norm <= NORM)
            for to, value in zip(out, (row, i, len(x), wide, norm, raw.tobytes() if wide else x.astype(np.int32).tobytes())):
                to.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["row", "vec_id", "dim", "wide", "norm", "vec"])


def opened(vec: bytes, wide: bool) -> np.ndarray:
    """The vector's integers, as float64."""
    if not wide:
        return np.frombuffer(vec, np.int32).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.floor(256.0 * np.frombuffer(vec, np.float64))


def exact(vec: bytes, wide: bool) -> list[int]:
    return [floor(256 * Fraction(x)) for x in np.frombuffer(vec, np.float64).tolist()] if wide else np.frombuffer(vec, np.int32).tolist()


@dataclass(frozen=True)
class Group:
    """Vectors of one length, narrow or wide: their number, the largest squared norm, and the pivots."""

    number: int
    top: float
    pivots: np.ndarray

    def far(self, x: np.ndarray, norms: np.ndarray, member: bool) -> np.ndarray:
        """Distances to the pivots, which are members, with their added coordinate; a query's own added one is 0."""
        with np.errstate(over="ignore", invalid="ignore"):
            lift = np.sqrt(np.maximum(self.top - (self.pivots * self.pivots).sum(1), 0.0))
            product = x @ self.pivots.T
            squared = 2 * self.top - 2 * (product + np.sqrt(np.maximum(self.top - norms, 0.0))[:, None] * lift) if member else norms[:, None] + self.top - 2 * product
            return np.sqrt(np.maximum(np.nan_to_num(squared, nan=0.0, posinf=np.inf), 0.0))

    def cells(self, far: np.ndarray) -> np.ndarray:
        """The two nearest pivots, as one number."""
        order = np.argsort(far, 1, kind="stable")
        return (order[:, 0] * len(self.pivots) + order[:, min(1, len(self.pivots) - 1)]).astype(np.int32)

    def may(self, bound: np.ndarray, norm: float | np.ndarray) -> np.ndarray:
        """The highest score that is possible at such a distance or more; rounding moves it by far less than what is added."""
        with np.errstate(over="ignore", invalid="ignore"):
            both = norm + self.top
            return np.nan_to_num((both - bound * bound) / 2 + 1e-9 * both + 1.0, nan=np.inf, posinf=np.inf)


def placed(groups: dict[tuple[int, bool], Group], member: bool):
    """ROWS to PLACED: a vector in its own group, or a query in all groups of its length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, wides = batch["dim"].to_numpy(), batch["wide"].to_numpy(zero_copy_only=False)
            norms, raw = batch["norm"].to_numpy(), batch["vec"].to_pylist()
            for dim, wide in sorted(set(zip(dims.tolist(), wides.tolist()))):
                at = np.flatnonzero((dims == dim) & (wides == wide))
                x = np.stack([opened(raw[i], wide) for i in at])
                for key, group in groups.items():
                    if key == (dim, wide) if member else key[0] == dim:
                        far = group.far(x, norms[at], member)
                        more = [pa.array(np.full(len(at), group.number)), pa.array([r.tobytes() for r in far], pa.binary()), pa.array(group.cells(far))]
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, *more], names=[*batch.schema.names, "grp", "far", "cell"])

    return rows


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, block, far) to (grp, block, low, high): the ranges of the distances that a task has seen."""
    seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for grp, block, raw in zip(*(batch[c].to_pylist() for c in ("grp", "block", "far"))):
            far = np.frombuffer(raw, np.float64)
            low, high = seen.get((grp, block), (far, far))
            seen[grp, block] = np.minimum(low, far), np.maximum(high, far)
    keys = list(seen)
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([seen[k][i].tobytes() for k in keys], pa.binary()) for i in (0, 1))]
    yield pa.RecordBatch.from_arrays(columns, names=["grp", "block", "low", "high"])


def search(k: int, groups: dict[int, Group], step: int = 1024):
    """In one block: the k best candidates of each query."""

    def block(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        group, queries, rows = groups[int(key[0])], both[both["asks"]], both[~both["asks"]]
        out: dict[str, list] = {"row": [], "query_id": [], "vec_id": [], "score": [], "over": [], "evaluated": []}
        if len(queries) and len(rows):
            rows = rows.sort_values(["vec_id", "row"], kind="stable")
            wide = bool(rows["wide"].iloc[0])
            ids, own, vecs = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["vec"].tolist()
            x = np.stack([opened(v, wide) for v in vecs])
            far = np.ascontiguousarray(np.frombuffer(b"".join(rows["far"]), np.float64).reshape(len(rows), -1).T)
            for row, query, vec, q_wide, norm, mine in zip(*(queries[c] for c in ("row", "vec_id", "vec", "wide", "norm", "far"))):
                q, bound = opened(vec, q_wide), np.zeros(len(rows))
                with np.errstate(invalid="ignore"):
                    for j, d in enumerate(np.frombuffer(mine, np.float64)):
                        np.fmax(bound, np.abs(far[j] - d), out=bound)
                may = group.may(bound, norm)
                order = np.argsort(-may)
                best: list[tuple[int, int]] = []  # (-score, place): places are in order of ids
                seen, some = 0, step
                while seen < len(order) and not (len(best) >= k and may[order[seen]] < -best[-1][0]):
                    part = order[seen : seen + some]
                    seen, some = seen + len(part), min(8192, 2 * some)
                    part = part[own[part] != row]
                    if wide or q_wide:
                        ints = exact(vec, q_wide)
                        scores = [sum(a * b for a, b in zip(exact(vecs[i], wide), ints)) for i in part]
                    else:
                        scores = (x[part] @ q).astype(np.int64) if max(group.top, norm) <= float(1 << 53) else x[part].astype(np.int64) @ q.astype(np.int64)
                        # Most can't be among the best: those below the k-th of these, or of those before.
                        least = np.partition(scores, -k)[-k] if len(scores) > k else -LONG
                        hit = scores >= max(int(least), -best[-1][0] if len(best) >= k else -LONG)
                        part, scores = part[hit], scores[hit].tolist()
                    best = sorted([*best, *((-s, int(i)) for s, i in zip(scores, part))])[:k]
                out["row"] += [row] * len(best)
                out["query_id"] += [query] * len(best)
                out["vec_id"] += [ids[i] for _, i in best]
                out["score"] += [min(max(-s, -LONG), LONG - 1) for s, _ in best]
                out["over"] += [not -LONG <= -s < LONG for s, _ in best]
                out["evaluated"] += [seen] * len(best)
        return pd.DataFrame(out).astype({c: "bool" if c == "over" else "int64" for c in out})

    return block


def reaching(groups: dict[int, Group], blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Queries, PLACED and with ``least``, to a row for each block that may hold a score of at least that."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = []
            for grp, norm, raw, least in zip(*(batch[c].to_pylist() for c in ("grp", "norm", "far", "least"))):
                names, low, high = blocks[grp]
                far = np.frombuffer(raw, np.float64)
                with np.errstate(invalid="ignore"):
                    bound = np.fmax(np.fmax(low - far, far - high), 0).max(1).astype(np.float64)
                found.append(names[groups[grp].may(np.nan_to_num(bound, nan=0.0), norm) >= (-np.inf if least is None else least)].tolist())
            part: list[tuple[int, int]] = []
            for i, own in enumerate(found):
                part += [(i, b) for b in own]
                if len(part) > 4096 or i == len(found) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array([i for i, _ in part], pa.int64())).columns, pa.array([b for _, b in part], pa.int64())], names=[*batch.schema.names, "block"])
                    part = []

    return rows


def in_blocks(cells: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(group, cell): rows, to (first block, blocks): cells that follow each other share a block, as long as it holds them; a
    larger cell has several."""
    out, following, held, group = {}, 0, 0, None
    for (grp, cell), rows in sorted(cells.items()):
        if held and (grp != group or held + rows > most):
            following, held = following + 1, 0
        group, parts = grp, -(-rows // most)
        out[grp, cell] = following, parts
        held += rows
        if parts > 1:
            following, held = following + parts, 0
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = 32, query_block: int = 2048, row_block: int = 16384, most_blocks: int = 1 << 17, share: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each query; queries are the rows with id divisible by ``every``.

    A group in memory holds at most about ``query_block`` queries and ``row_block`` candidates; more candidates only where there
    would be over ``most_blocks`` blocks, whose ranges (float32, 34 MB at most by default) are broadcast.  Pivots are the ``pivots`` rows
    of each group that come first by a hash of their id.  A query first meets one in ``share`` of its nearest block.
    """
    spark = vectors.sparkSession
    whole = materialize(map_arrow(vectors.select("vec_id", "embedding"), quantized, ROWS), "vectors")
    # A row for each length of vectors.
    sizes = sorted((r["dim"], r["wide"], r["top"], r["rows"]) for r in whole.groupBy("dim", "wide").agg(F.max("norm").alias("top"), F.count("*").alias("rows")).collect())
    groups: dict[tuple[int, bool], Group] = {}
    for number, (dim, wide, top, _) in enumerate(sizes):
        first = whole.filter((F.col("dim") == dim) & (F.col("wide") == wide)).orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).select("vec").collect()
        groups[dim, wide] = Group(number, float(top), np.stack([opened(r["vec"], wide) for r in first]))
    of = {g.number: g for g in groups.values()}
    row_block = max(row_block, -(-sum(s[3] for s in sizes) // max(1, most_blocks - pivots * len(sizes))))
    cells = whole.mapInArrow(placed(groups, True), PLACED)
    counts = [tuple(r) for r in cells.groupBy("grp", "cell").agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).collect()]
    blocked = in_blocks({(g, c): n for g, c, n, _ in counts}, row_block)
    anywhere = {g: place for (g, _), place in sorted(blocked.items(), reverse=True)}
    # At most pivots * pivots rows a group; a query's cell may have no row in another group than its own.
    own = {(g, c) for g in of for c in range(of[g].pivots.shape[0] ** 2)}
    plan = spark.createDataFrame([(g, c, *blocked.get((g, c), anywhere[g])) for g, c in sorted(own)], "grp long, cell int, first long, parts long")
    dealt = cells.join(F.broadcast(plan), ["grp", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")))
    fields = ["grp", "block", "row", "vec_id", "wide", "norm", "vec", "far"]
    rows = materialize(dealt.select(*fields), "vectors-dealt")

    asked = whole.filter(F.col("vec_id") % every == 0).mapInArrow(placed(groups, False), PLACED)
    ask = [*fields, "part", "asks"]

    def near() -> DataFrame:
        """Queries, with each block that may hold one of their k best."""

        def merged(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            low, high = (np.stack([np.frombuffer(r, np.float64) for r in parts[c]]) for c in ("low", "high"))
            # Rounded outwards.
            outward = lambda x, to: np.nextafter(x.astype(np.float32), np.float32(to)).tobytes()
            with np.errstate(over="ignore"):
                return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "low": [outward(np.minimum(low.min(0), 3e38), -np.inf)], "high": [outward(high.max(0), np.inf)]})

        kept = rows.select("grp", "block", "far").mapInArrow(spans, "grp long, block long, low binary, high binary").groupBy("grp", "block").applyInPandas(merged, "grp long, block long, low binary, high binary").collect()
        blocks = {}
        for grp in of:
            mine = sorted((r for r in kept if r["grp"] == grp), key=lambda r: r["block"])
            blocks[grp] = np.array([r["block"] for r in mine], np.int64), *(np.stack([np.frombuffer(r[c], np.float32) for r in mine]) for c in ("low", "high"))
        shared = spark.sparkContext.broadcast(blocks)

        # Any of its block's rows give a query a score to beat.
        heads = -(-max([0, *(q for *_, q in counts)]) // query_block) or 1
        home = asked.join(F.broadcast(plan), ["grp", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts"))).withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(heads)))
        some = rows.filter(F.pmod(F.xxhash64("row", F.lit(4)), F.lit(share)) == 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(heads - 1).cast("long"))))
        tried = home.withColumn("asks", F.lit(True)).select(*ask).unionByName(some.withColumn("asks", F.lit(False)).select(*ask))
        tried = tried.groupBy("grp", "block", "part").applyInPandas(search(k, of), FOUND)
        best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k)
        least = tried.groupBy("row").agg(best.alias("best")).filter(F.size("best") >= k).select("row", F.element_at("best", k).alias("least"))

        def going(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from reaching(of, shared.value)(batches)

        bound = asked.join(materialize(least, "vectors-least"), "row", "left")
        return materialize(map_arrow(bound, going, f"{PLACED}, least long, block long").select(*fields), "vectors-asked")

    if any(first + parts > 1 + anywhere[g][0] for (g, _), (first, parts) in blocked.items()):
        goes = near()
    else:  # a block for each group: nothing to choose
        goes = asked.join(F.broadcast(plan), ["grp", "cell"]).select(*fields[:1], F.col("first").alias("block"), *fields[2:])
    # A block's queries are split where they are many, and its rows go to as many places.
    asking = goes.groupBy("grp", "block").agg(F.ceil(F.count("*") / query_block).alias("parts"))
    queries = goes.join(asking, ["grp", "block"]).withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.col("parts"))).withColumn("asks", F.lit(True))
    candidates = rows.join(asking, ["grp", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    found = queries.select(*ask).unionByName(candidates.select(*ask)).groupBy("grp", "block", "part").applyInPandas(search(k, of), FOUND)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    fits = F.when(F.col("over"), F.raise_error(F.concat(F.lit("a score does not fit a long: query "), F.col("query_id").cast("string"))).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", fits.alias("score"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.id <> q.id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
