"""Exact line dedup across documents.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Hashes (128 bits) of keys are
range-partitioned and sorted by hash, document and position; one pass over each partition streams the first
holder of a key past and reports the places of all other holders' lines.  As ranges run over document and position
too, a key that millions of documents hold fills several partitions: each partition reports its last key's first
holder, and what looks like a first holder at the head of a partition is settled against those few rows.  The result
is a compressed bitmap of kept lines for each document that loses any; texts move only when bitmaps are applied.

Defined cases: a null or empty text is one empty line; texts and lines of any length are taken as a whole; an empty table gives an empty result; rows that share a
doc_id are one holder, and so are the rows with a null doc_id, which come last in order; a key that one document
repeats stays; columns besides ``doc_id`` and ``text`` pass through ``dedup_texts`` untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import concluded, free, map_arrow, materialize, with_maybe

SPACE = " \t\n\v\f\r"
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
PLACES = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())])
SEEN = pa.schema([("kind", pa.int32()), *PLACES])
DROP, HEAD, TAIL = 0, 1, 2


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(FOLD)


def keyed_lines(least: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc, mark, text in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"].to_pylist()):
                for pos, line in enumerate((text or "").split("\n")):
                    if len(line) >= least and len(key := line_key(line)) >= least:
                        for to, value in zip(rows, (xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")), doc, mark, pos)):
                            to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, PLACES)], schema=PLACES)

    return places


def stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (h, doc_id, pos): what goes for certain, what depends on earlier partitions, the last key."""
    key, first, keys = None, None, 0
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch[name].to_pylist() for name in PLACES.names)):
            if row[0] != key:
                key, first, keys = row[0], row[1], keys + 1
            if row[1] != first:
                out.append((DROP, *row))
            elif keys == 1:
                out.append((HEAD, *row))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(SEEN)], schema=SEEN)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((TAIL, key, first, None, None), SEEN)], schema=SEEN)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for gone in batch["gone"].to_pylist():
            keep = np.ones((max(gone) // 8 + 1) * 8, np.uint8)
            keep[gone] = 0
            bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(bits, pa.binary())], names=["doc_id", "mark", "keep"])


def unpack(keep: bytes | None, lines: int) -> np.ndarray:
    """Which of so many lines stay; lines after the bitmap's end do."""
    out = np.ones(lines, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:lines].astype(bool)
        out[: len(bits)] = bits
    return out


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, mark (a hash of the text), keep (zlib of a bitmap, a bit a line): a row for each document that loses lines.

    The bits after the last lost line are set.
    """
    return concluded(docs.sparkSession, lambda: bitmaps_of(docs, least), "line-bitmaps")


def bitmaps_of(docs: DataFrame, least: int) -> DataFrame:
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    # Written, as range partitioning looks at its input twice: once for a sample of the ranges.
    places = materialize(map_arrow(marked, keyed_lines(least), "h binary, doc_id long, mark long, pos int"), "line-keys")
    order = [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("pos")]
    ranged = places.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = materialize(ranged.mapInArrow(stream_firsts, "kind int, h binary, doc_id long, mark long, pos int"), "line-places")
    # A row for each partition at most.
    tails = seen.filter(F.col("kind") == TAIL).groupBy("h").agg(F.min("doc_id").alias("earliest"))
    heads = seen.filter(F.col("kind") == HEAD).join(tails, "h").filter(F.col("earliest") < F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    gone = seen.filter(F.col("kind") == DROP).select("doc_id", "mark", "pos").unionByName(heads.select("doc_id", "mark", "pos"))
    each = gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))
    return map_arrow(each, pack, "doc_id long, mark long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with each document's bitmap, or null, as the last column."""
    ids, mark, keep = free(docs, "_id", "_mark", "_keep")
    bits = bitmaps.select(F.col("doc_id").alias(ids), F.col("mark").alias(mark), F.col("keep").alias(keep))
    (maybe,) = free(docs, "_maybe")
    # Documents that certainly lose nothing stay where they are.
    marked = with_maybe(docs, bitmaps, maybe)
    sure = marked.filter(~F.col(maybe)).select(*docs.columns, F.lit(None).cast("binary").alias(keep))
    rest = marked.filter(F.col(maybe)).drop(maybe)
    joined = rest.join(bits, rest["doc_id"].eqNullSafe(bits[ids]) & (F.xxhash64(rest["text"]) == bits[mark]), "left")
    return sure.unionByName(joined.select(*docs.columns, keep))


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    stay = unpack(keep, len(lines))
    return "\n".join(x for x, k in zip(lines, stay) if k), len(lines), int(len(lines) - stay.sum())


def dedup_texts(docs: DataFrame, least: int = 10) -> DataFrame:
    """``docs`` with the lines that stay; a null text stays null.  Other columns as they were."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, least))
    at = joined.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if k is None else kept_lines(t, k)[0] for t, k in zip(batch["text"].to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else batch[i] for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_arrow(joined, apply, docs.schema)


def digest(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 (of the kept lines joined by \\n, in UTF-8)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = zip(*(kept_lines(t, k) for t, k in zip(batch["text"].to_pylist(), batch.column(batch.num_columns - 1).to_pylist()))) if batch.num_rows else ((), (), ())
            hashes = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, least))
    return map_arrow(joined, apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), held AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, held.first IS NOT NULL AND held.first <> doc_id AS gone FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
