"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where none is named and all runs in one process (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='bytelode-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what is read later survives the loss of any executor.  The files go when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # What the write has shuffled goes with its end: it is of no more use, and would fill disks until the driver collects garbage.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """The path's file system, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: The tables that each ``concluded`` under way has had written so far.
_passing: list[list[str]] = []


def concluded(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, materialized; the tables that were materialized on the way go, as nothing reads them any more.

    So nothing else that ``make`` has derived from them may be used later.
    """
    _passing.append(passed := [])
    try:
        out = make()
    finally:
        _passing.pop()
    out = materialize(out, name)
    for path in passed:
        files, at = _files(spark, path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
    return out


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to be added: those wanted, with so many underscores before them that the table has none of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


#: Words of 64 bits of the filters below; a filter is a table of at most so many rows, whatever it is made of.
FILTER_WORDS = 1 << 16


def with_maybe(rows: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``rows`` with a boolean column: false only if the key is certainly not among ``ids`` (one hash, a fixed number of bits).

    Serves to leave most rows out of a shuffle; what is true needs an exact join yet.
    """
    spot = f"pmod(xxhash64({key}), {64 * FILTER_WORDS})"
    word, bit = free(rows, "_word", "_bits")
    bits = ids.groupBy(F.expr(f"{spot} div 64").alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({spot} % 64 AS INT))")).alias(bit))
    # At most FILTER_WORDS rows of 16 bytes.
    found = rows.join(F.broadcast(bits), F.expr(f"{spot} div 64") == F.col(word), "left")
    return found.withColumn(name, F.expr(f"coalesce(shiftrightunsigned({bit}, CAST({spot} % 64 AS INT)) & 1, 0) = 1")).drop(word, bit)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` whose key is not among ``ids``; only those that may be are shuffled."""
    (maybe,) = free(rows, "_maybe")
    marked = with_maybe(rows, ids, maybe, key)
    sure = marked.filter(~F.col(maybe)).drop(maybe)
    return sure.unionByName(marked.filter(F.col(maybe)).drop(maybe).join(ids, key, "left_anti").select(*rows.columns))


def arrow_batches(spark: SparkSession, records: int = 2048, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch of whole texts may hold; smaller bounds that the session has stay.

    The session keeps them, as batches are made when a result is read, long after this call.
    """
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}") or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    arrow_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


class Memory(dict):
    """key: what ``find`` makes of it, never None.

    When it grows large, what it holds is put aside until it has grown so large again, so that common keys are not found anew.
    """

    most = 200_000

    def __init__(self):
        super().__init__()
        self.aside = {}

    def __missing__(self, key):
        if len(self) > self.most:
            self.aside = dict(self)
            self.clear()
        out = self.aside.get(key)
        if out is None:
            out = self.find(key)
        self[key] = out
        return out

    def find(self, key):
        raise NotImplementedError


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows outside the held-out fold, half of them of each label.

    The rows that come first by a hash of their id; a document with several labels counts with the smallest, one of which
    several rows have the id with its smallest text.  The bound makes it safe to broadcast the ids, and to collect the rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != held))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"))
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(limit // 2) for v in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def label_share(labels: DataFrame, label: str, modulus: int, held: int) -> float | None:
    """The share of label 0 among the labelled documents outside the held-out fold; None without any."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", modulus) != held)).groupBy("doc_id").agg(F.min(label).alias("label"))
    return known.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
