"""Algebra of ranges [start, end) within files: nesting, gaps, padding, coverage, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelode.functions.binary import single_byte, slice_bytes


def outer(chunks: DataFrame, by: str = "file_id") -> DataFrame:
    """``chunks`` without those that lie in a larger one of the same file; of equal ranges all stay.

    Distinct ranges are swept in order of start, the longer first: one is outer if it ends beyond all before it.  One
    shuffle, by file: rows of one range travel together.
    """
    rest = [c for c in chunks.columns if c not in (by, "start", "end")]
    order = Window.partitionBy(by).orderBy(F.col("start"), F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = chunks.repartition(by).groupBy(by, "start", "end").agg(F.collect_list(F.struct(*rest, F.lit(0).alias("_one"))).alias("_rows")).withColumn("_reach", reach)
    kept = ranges.filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("end")))
    return kept.select(by, "start", "end", F.inline("_rows")).select(*chunks.columns)


def gaps(chunks: DataFrame, files: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, start, end, overlap) of what no chunk covers, before, between and after them; files without chunks have none.

    ``files`` has (by, length).  Where neighbours overlap, the row has ``overlap`` true and the range that both cover.
    """
    order = Window.partitionBy(by).orderBy("start", "end")
    before = F.coalesce(F.lag("end").over(order), F.lit(0))
    between = chunks.select(by, before.alias("_from"), F.col("start").alias("_to"))
    tail = chunks.groupBy(by).agg(F.max("end").alias("_from")).join(files.select(by, F.col("length").alias("_to")), by).select(by, "_from", "_to")
    return (
        between.unionByName(tail).filter("_from <> _to")
        .select(by, F.least("_from", "_to").alias("start"), F.greatest("_from", "_to").alias("end"), (F.col("_from") > F.col("_to")).alias("overlap"))
    )


def padded(gaps: DataFrame, files: DataFrame, by: str = "file_id") -> DataFrame:
    """``gaps`` with kind: padding (one byte value over and over) or unknown; ``files`` has (by, content).

    A file's ranges are gathered, so that each file's content meets them once, and is copied into no row.
    """
    rest = [c for c in gaps.columns if c != by]
    own = gaps.groupBy(by).agg(F.collect_list(F.struct(*rest)).alias("_ranges"))
    single = lambda r: single_byte(slice_bytes(F.col("content"), r["start"], r["end"]))
    told = F.transform("_ranges", lambda r: r.withField("kind", F.when(single(r), "padding").otherwise("unknown")))
    return files.select(by, "content").join(own, by).select(by, told.alias("_told")).select(by, F.inline("_told")).select(*gaps.columns, "kind")


def outer_of(ranges: list[tuple[int, int]]) -> list[int]:
    """The places of a file's ranges that lie in no larger one; the same as ``outer``, for ranges that are at hand."""
    order = sorted(range(len(ranges)), key=lambda i: (ranges[i][0], -ranges[i][1]))
    kept, reach, last = [], -1, None
    for i in order:
        if ranges[i][1] > reach or ranges[i] == last:
            kept.append(i)
            if ranges[i][1] > reach:
                reach, last = ranges[i][1], ranges[i]
    return kept


def gaps_of(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """What none of a file's ranges covers; none where there are no ranges."""
    out, at = [], 0
    for start, end in sorted(ranges):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return out + [(at, length)] if ranges and at < length else out


def coverage(chunks: DataFrame, files: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, length, covered): bytes in outer chunks; overlapping ones count once."""
    order = Window.partitionBy(by).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = chunks.select(by, F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reach)).alias("own")).groupBy(by).agg(F.sum("own").alias("covered"))
    return files.select(by, "length").join(own, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def differences(rows: DataFrame, by: str, value: str | Column) -> DataFrame:
    """(by, difference) of consecutive values."""
    x = F.col(value) if isinstance(value, str) else value
    step = rows.select(by, x.alias("_x")).withColumn("difference", F.col("_x") - F.lag("_x").over(Window.partitionBy(by).orderBy("_x")))
    return step.filter(F.col("difference").isNotNull()).select(by, "difference")


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the commonest value; of several the smallest.  Counted before anything is gathered by group."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    return counts.groupBy(by).agg(best.alias("b")).select(by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))
