"""The analysis of files, and of what is found in them, level by level.

A level is a table of files at one depth.  Sets of files in several parts are found first, and put together.  All other files are looked
at once, where they are: searched, their chunks reduced to the outer ones, gaps classified and measured, chunks unpacked.  What comes out are
the files of the next level.  No content is shuffled but that of parts and of equal files.  Each level is written as a
table before the next begins, so that lineage stays short; the driver holds the level's number and whether it has files.
"""

from __future__ import annotations

import hashlib
import logging
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.functions.batches import map_batches
from bytelode.operators import extract, intervals, measures, multifile, scan
from bytelode.sources import files as source
from bytelode.sources import sinks

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    """What an analysis does: see the command line of the same names in the README.

    delete: formats whose containers go once they are unpacked, or "all".  kinds: directory formats.  commands: whether other programs
    may unpack what the library doesn't.
    """

    max_depth: int = 10
    randomness_depth: int = 1
    skip_kinds: tuple[str, ...] = source.SKIPPED_KINDS
    skip_suffixes: tuple[str, ...] = source.SKIPPED_SUFFIXES
    handlers: tuple[str, ...] | None = None
    skip_extraction: bool = False
    delete: tuple[str, ...] | str = ()
    formats: tuple = field(default=())
    kinds: tuple[multifile.Parts, ...] = multifile.KINDS
    commands: bool = False


@dataclass(frozen=True)
class Analysis:
    """tasks: files of all levels, with hashes and kinds; chunks; gaps; randomness; entries; errors of the search; sets of files in parts;
    collisions of sets; deleted: containers that may go.  All have file_id, and depth."""

    tasks: DataFrame
    chunks: DataFrame
    gaps: DataFrame
    randomness: DataFrame
    entries: DataFrame
    errors: DataFrame
    sets: DataFrame
    collisions: DataFrame
    deleted: DataFrame


def chunk_id(file_id: str, start: int, end: int, handler: str) -> str:
    return hashlib.sha256(f"{file_id}:{start}:{end}:{handler}".encode()).hexdigest()


def stored(df: DataFrame, folder: str, name: str, depth: int) -> DataFrame:
    path = f"{folder}/{name}/depth={depth}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MEASURE = "struct<percentages:array<double>,block_size:bigint,mean:double>"
OPENED = f"what string, file_id string, start long, end long, handler string, is_encrypted boolean, chunk_id string, kind string, shannon {_MEASURE}, chi_square {_MEASURE}, error string, severity string, entry struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in extract.ENTRIES.split(', ')).replace(':long', ':bigint')}>"
_KIND = pa.struct([("percentages", pa.list_(pa.float64())), ("block_size", pa.int64()), ("mean", pa.float64())])
_OPENED = pa.schema([
    ("what", pa.string()), ("file_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("handler", pa.string()), ("is_encrypted", pa.bool_()), ("chunk_id", pa.string()), ("kind", pa.string()),
    ("shannon", _KIND), ("chi_square", _KIND), ("error", pa.string()), ("severity", pa.string()), ("entry", pa.struct([(f.name, f.type) for f in extract.SCHEMA])),
])


def opener(config: Config, measure: bool):
    """(file_id, content) to OPENED: one look at each file's content for all that needs it."""

    def found_in(file_id: str, data: bytes, scanner: scan.Scanner) -> Iterator[dict]:
        hits = scanner.search(data)
        for handler, start, _, _, severity, error in hits:
            if error:
                yield {"what": "error", "file_id": file_id, "start": start, "handler": handler, "severity": severity, "error": error}
        chunks = [h for h in hits if not h[5]]
        yield from ({"what": "found", "file_id": file_id, "start": c[1], "end": c[2], "handler": c[0], "is_encrypted": c[3]} for c in chunks)
        chunks = [chunks[i] for i in intervals.outer_of([(c[1], c[2]) for c in chunks])]
        for handler, start, end, encrypted, _, _ in chunks:
            own = chunk_id(file_id, start, end, handler)
            yield {"what": "chunk", "file_id": file_id, "start": start, "end": end, "handler": handler, "is_encrypted": encrypted, "chunk_id": own}
            if not config.skip_extraction:
                for e in extract.unpack(data[start:end], handler, bool(encrypted), config.commands):
                    yield {"what": "entry", "file_id": file_id, "entry": {"parent_id": own, "handler": handler, "path": e.path, "type": e.type, "mode": e.mode, "size": len(e.content or b""), "link_target": e.link_target, "content": e.content, "problem": e.problem, "resolution": e.resolution, "severity": e.severity}}
        for start, end in intervals.gaps_of([(c[1], c[2]) for c in chunks], len(data)) if chunks else [(0, len(data))]:
            part = data[start:end]
            kind = "padding" if chunks and part.count(part[:1]) == len(part) else "unknown"
            row = {"what": "gap" if chunks else "bare", "file_id": file_id, "start": start, "end": end, "kind": kind, "chunk_id": chunk_id(file_id, start, end, kind) if chunks else None}
            if measure and kind == "unknown":
                row["shannon"], row["chi_square"] = measures.randomness(part)
            yield row

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scan.scanner(tuple(sorted(config.handlers)) if config.handlers is not None else None, config.formats)
        for batch in batches:
            for file_id, content in zip(batch["file_id"].to_pylist(), batch["content"]):
                out: list[dict] = []
                held = 0
                for row in found_in(file_id, content.as_py() or b"", scanner):
                    out.append(row)
                    held += (row.get("entry") or {}).get("size", 0)
                    if len(out) >= 256 or held > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_OPENED)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=_OPENED)

    return rows


def put_together(commands: bool):
    """The parts of a set, (set_id, handler, paths, path, content), to ENTRIES."""

    def unpack(pdf: pd.DataFrame) -> pd.DataFrame:
        order = {p: i for i, p in enumerate(pdf["paths"].iloc[0])}
        parts = [bytes(c) for c in pdf.sort_values("path", key=lambda p: p.map(order))["content"]]
        handler = pdf["handler"].iloc[0]
        # The one format of parts whose pieces say nothing together is unpacked by what its name says, if at all.
        inner = handler.removeprefix("multi-")
        made = list(extract.unpack(b"".join(parts), inner if inner in extract.EXTRACTORS or any(f.name == inner for f in extract.FORMATS) else handler, False, commands))
        rows = [(pdf["set_id"].iloc[0], handler, e.path, e.type, e.mode, len(e.content or b""), e.link_target, e.content, e.problem, e.resolution, e.severity) for e in made]
        return pd.DataFrame(rows, columns=extract.NAMES)

    return unpack


def level(files: DataFrame, depth: int, config: Config, folder: str) -> dict[str, DataFrame]:
    """The tables of one level; ``files`` has (file_id, path, length, content, magic)."""
    skip = source.skipped(F.col("magic"), F.col("path"), config.skip_kinds, config.skip_suffixes)
    out: dict[str, DataFrame] = {}
    named = "|".join(f"(?:{k.pattern})" for k in config.kinds)
    if depth < config.max_depth and named and not files.filter(F.element_at(F.split("path", "/"), -1).rlike(named)).isEmpty():
        sets = multifile.multi_files(files, config.kinds).withColumn("set_id", F.sha2(F.concat_ws(":", "handler", "folder", "name", F.array_join("paths", ":")), 256))
        sets = stored(sets, folder, "sets", depth)
        if not sets.isEmpty():
            out["collisions"] = source.collisions(sets).withColumn("file_id", F.sha2("path", 256))
            # Sets that claim one path are not put together; whichever are, their parts are not searched again.
            claimed = sets.select("set_id", F.explode("paths").alias("path")).join(out["collisions"].select("path"), "path", "left_semi").select("set_id").distinct()
            good = sets.join(claimed, "set_id", "left_anti")
            parts = good.select("set_id", "handler", "paths", F.explode("paths").alias("path")).join(files.select("path", "content"), "path")
            out["sets"] = sets.withColumn("file_id", F.col("set_id"))
            if not config.skip_extraction:
                out["entries"] = stored(parts.groupBy("set_id").applyInPandas(put_together(config.commands), extract.ENTRIES), folder, "together", depth)
            files = source.children(files, good.select(F.explode("paths").alias("path")), files.select("path").limit(0))
    searched = files.filter((F.col("length") > 0) & ~skip) if depth < config.max_depth else files.filter(F.lit(False))
    opened = stored(map_batches(searched.select("file_id", "content"), opener(config, depth < config.randomness_depth), OPENED), folder, "opened", depth)
    out["found"] = opened.filter("what = 'found'").select("file_id", "handler", "start", "end", "is_encrypted")
    out["errors"] = opened.filter("what = 'error'").select("file_id", "handler", "start", "severity", "error")
    out["chunks"] = opened.filter("what = 'chunk'").select("file_id", "handler", "start", "end", "is_encrypted", "chunk_id")
    out["gaps"] = opened.filter("what = 'gap'").select("file_id", "start", "end", F.lit(False).alias("overlap"), "kind", "chunk_id")
    if depth < config.randomness_depth:
        out["randomness"] = opened.filter("shannon IS NOT NULL").select("file_id", "chunk_id", "start", "end", "shannon", "chi_square")
    if not config.skip_extraction:
        own = opened.filter("what = 'entry'").select("entry.*")
        out["entries"] = out["entries"].unionByName(own) if "entries" in out else own
        wrong = own.filter("severity = 'ERROR'").select(F.col("parent_id").alias("chunk_id")).distinct()
        whole = out["chunks"].join(files.select("file_id", "path", "length"), "file_id").withColumn("depth", F.lit(depth)).join(wrong, "chunk_id", "left_anti")
        out["deleted"] = whole.filter(sinks.deleted(whole, config.delete)).select("file_id", "path", "handler", "chunk_id")
    return out


def analyse(files: DataFrame, folder: str, config: Config = Config()) -> Analysis:
    """All levels, as tables below ``folder`` (a shared one)."""
    spark = files.sparkSession
    folder = f"{folder.rstrip('/')}/analysis-{uuid.uuid4().hex}"
    tables: dict[str, list[DataFrame]] = {}
    current = files.select(F.col("file_id").cast("string").alias("file_id"), "path", "length", "content", F.lit("").alias("blob_id"))
    for depth in range(config.max_depth + 1):
        looked = current.withColumns({"md5": F.md5("content"), "sha1": F.sha1("content"), "sha256": F.sha2("content", 256), "magic": source.signature(F.col("content"), source.SIGNATURES)})
        current = stored(looked, folder, "tasks", depth)
        if log.isEnabledFor(logging.INFO):
            log.info("depth %d: %d files", depth, current.select("file_id").count())
        made = level(current, depth, config, folder)
        made["tasks"] = current.drop("content").withColumn("mime_type", source.mime_type(F.col("magic")))
        for name, df in made.items():
            tables.setdefault(name, []).append(df.withColumn("depth", F.lit(depth)))
        if "entries" not in made or depth == config.max_depth:
            break
        path = F.concat_ws("/", "parent_id", "path")
        # Of members of one name the last one counts; files alone are searched on.
        current = made["entries"].filter("type = 'file' AND content IS NOT NULL AND size > 0").select(F.sha2(F.concat_ws(":", "parent_id", "path", F.sha2("content", 256)), 256).alias("file_id"), path.alias("path"), F.col("size").alias("length"), "content", F.col("parent_id").alias("blob_id")).dropDuplicates(["file_id"])
        if current.isEmpty():
            break
    whole = {name: _union(dfs) for name, dfs in tables.items()}
    empty = {
        "randomness": f"file_id string, chunk_id string, start long, end long, shannon {_MEASURE}, chi_square {_MEASURE}, depth int", "entries": f"{extract.ENTRIES}, depth int", "errors": "file_id string, handler string, start long, severity string, error string, depth int",
        "sets": "handler string, folder string, name string, paths array<string>, length long, set_id string, file_id string, depth int", "collisions": "path string, sets long, file_id string, depth int", "deleted": "file_id string, path string, handler string, chunk_id string, depth int",
    }
    return Analysis(**{name: whole[name] if name in whole else _empty(spark, empty[name]) for name in Analysis.__dataclass_fields__})


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def lineage(edges: DataFrame, roots: DataFrame, most: int = 10) -> DataFrame:
    """(root, node, depth): what is reached from each root by (parent, child) rows, to a depth; a round is one join."""
    reached = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = reached
    for depth in range(1, most + 1):
        front = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth"))
        reached = reached.unionByName(front)
    return reached
