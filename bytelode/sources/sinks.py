"""Writing what was found as files, for those who want files; the tables are the results."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from bytelode.functions import paths
from bytelode.functions.binary import slice_bytes


def carved(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content): ``{start}-{end}.{kind}`` in a folder named after the file; chunks of a file that is one whole chunk aren't carved."""
    kind = F.coalesce(*[F.col(c) for c in ("handler", "kind") if c in chunks.columns])
    own = chunks.groupBy("file_id").agg(F.collect_list(F.struct("start", "end", kind.alias("kind"))).alias("ranges"))
    # A file's content meets all of its ranges at once; slices, not copies of it, become rows.
    part = lambda r: F.struct(
        F.concat(F.col("file_id"), F.lit("_extract/"), r["start"], F.lit("-"), r["end"], F.lit("."), r["kind"]).alias("path"), slice_bytes(F.col("content"), r["start"], r["end"]).alias("content")
    )
    some = F.filter("ranges", lambda r: (r["start"] > 0) | (r["end"] < F.col("length")))
    return files.select("file_id", "length", "content").join(own, "file_id").select(F.inline(F.transform(some, part)))


def write_files(rows: DataFrame, folder: str, exist_ok: bool = False) -> None:
    """(path, content) as files below a folder that all executors share.  A task that runs again writes the same files again.

    A file appears under its name only when it is whole; unless ``exist_ok``, one of that name with other content is an error.
    """

    def write(part: Iterator[Row]) -> None:
        for row in part:
            inside = paths.normal(row.path)
            if inside is None:
                raise ValueError(f"{row.path!r} leaves the folder")
            target, content = Path(folder) / inside, bytes(row.content or b"")
            if target.exists() and not exist_ok and target.read_bytes() != content:
                raise FileExistsError(target)
            target.parent.mkdir(parents=True, exist_ok=True)
            made = target.with_name(f".{target.name}.{os.getpid()}")
            made.write_bytes(content)
            made.replace(target)

    rows.select("path", "content").foreachPartition(write)


def deleted(chunks: DataFrame, handlers: tuple[str, ...] | str = ()) -> Column:
    """Whether a container may go after it was unpacked: none, ``all``, or those of some formats; only whole files below depth 0."""
    chosen = F.lit(True) if handlers == "all" else F.col("handler").isin(*handlers) if handlers else F.lit(False)
    whole = (F.col("start") == 0) & (F.col("end") == F.col("length"))
    return chosen & whole & (F.col("depth") > 0)
