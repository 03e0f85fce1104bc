"""Randomness of bytes: Shannon entropy and the chi-square test, whole or by block.

Histograms are counted in Arrow batches with numpy; a byte is looked at once for both measures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.functions.batches import map_batches
from bytelode.functions.binary import latin1

SHANNON = "percentages array<double>, block_size long, mean double"
RANDOMNESS = f"shannon struct<percentages:array<double>,block_size:bigint,mean:double>, chi_square struct<percentages:array<double>,block_size:bigint,mean:double>"
MIN_BLOCK, MAX_BLOCK, BLOCKS = 1024, 1 << 20, 80


def entropy_of(counts: np.ndarray) -> float:
    n = counts.sum()
    p = counts[counts > 0] / n if n else np.zeros(0)
    return float(max(0.0, -(p * np.log2(p)).sum()))


def survival(x: float, freedom: int) -> float:
    """P(chi-square with ``freedom`` degrees > x): the regularized upper incomplete gamma function of (freedom / 2, x / 2)."""
    a, z = freedom / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(min(0.0, a * math.log(z) - z - math.lgamma(a)) if a * math.log(z) - z - math.lgamma(a) < 0 else a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return min(1.0, max(0.0, 1 - total * scale))
    # Lentz's continued fraction.
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, max(0.0, out * scale))


def chi_square_of(counts: np.ndarray) -> float:
    """The chance that uniformly random bytes differ from uniform as much as these; 0 for none."""
    n = counts.sum()
    if not n:
        return 0.0
    return survival(float(((counts - n / 256) ** 2).sum() / (n / 256)), 255)


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def block_size_of(size: int) -> int:
    return min(max(size // BLOCKS, MIN_BLOCK), MAX_BLOCK)


def randomness(data: bytes, block: int | None = None) -> tuple[dict, dict]:
    """Percentages by block, to two decimals, and the mean over bytes, not rounded, of entropy and of the chi-square test."""
    block = block or block_size_of(len(data))
    parts = [data[i : i + block] for i in range(0, len(data), block)]
    counts = [histogram(p) for p in parts]
    sizes = [len(p) for p in parts]
    out = []
    for measure in (lambda c: round(entropy_of(c) / 8 * 100, 2), lambda c: round(chi_square_of(c) * 100, 2)):
        values = [measure(c) for c in counts]
        out.append({"percentages": values, "block_size": block, "mean": sum(v * s for v, s in zip(values, sizes)) / len(data) if data else 0.0})
    return out[0], out[1]


def with_randomness(blobs: DataFrame, content: str = "content") -> DataFrame:
    """``blobs`` with shannon and chi_square in place of the content."""
    rest = [f for f in blobs.schema.fields if f.name != content]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("percentages", pa.list_(pa.float64())), ("block_size", pa.int64()), ("mean", pa.float64())])
        for batch in batches:
            found = [randomness(x or b"") for x in batch[content].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in rest), *(pa.array([x[i] for x in found], kind) for i in (0, 1))], names=[*(f.name for f in rest), "shannon", "chi_square"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), RANDOMNESS])
    return map_batches(blobs, measure, schema)


def byte_measures(blobs: DataFrame, content: str = "content") -> DataFrame:
    """``blobs`` with entropy (bits a byte), chi_square (the statistic) and p_value in place of the content."""
    rest = [f for f in blobs.schema.fields if f.name != content]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [histogram(x or b"") for x in batch[content].to_pylist()]
            statistic = [float((c.astype(np.float64) ** 2).sum() * 256 / c.sum() - c.sum()) if c.sum() else 0.0 for c in counts]
            columns = [[entropy_of(c) for c in counts], statistic, [chi_square_of(c) for c in counts]]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in rest), *(pa.array(x, pa.float64()) for x in columns)], names=[*(f.name for f in rest), "entropy", "chi_square", "p_value"])

    return map_batches(blobs, measure, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "entropy double, chi_square double, p_value double"]))


def blocks(blobs: DataFrame, size: Column | int, content: str = "content") -> DataFrame:
    """A row for each block of the content, the last one short: block_no and the block as ``content``."""
    step = F.lit(size) if isinstance(size, int) else size
    n = F.octet_length(content)
    numbers = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / step).cast("int"), F.lit(0)))
    rest = [c for c in blobs.columns if c != content]
    # Pieces are unfolded, not numbers: the whole content is in no row twice.
    pieces = F.transform(numbers, lambda i: F.substring(F.col(content), (i * step + 1).cast("int"), step.cast("int")))
    return blobs.filter(n > 0).select(*rest, F.posexplode(pieces).alias("block_no", content))


def byte_counts(blobs: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """(by, byte, n) with SQL functions only: for small content, or where the histogram itself is wanted."""
    return blobs.select(*by, F.explode(F.split(latin1(F.col(content)), "")).alias("byte")).filter("byte <> ''").groupBy(*by, "byte").agg(F.count("*").alias("n"))
