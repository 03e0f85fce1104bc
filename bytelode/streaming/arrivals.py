"""Files as they arrive: a stream over a folder, searched batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytelode.operators import scan

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, at_once: int = 1000) -> DataFrame:
    """(file_id, path, length, content) of files that come into a folder, as a stream."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", str(at_once)).load(path)
    return files.select(F.sha2("path", 256).alias("file_id"), "path", "length", "content")


def found(files: DataFrame, **options) -> DataFrame:
    """Chunks of arriving files; the search keeps no state between files."""
    return scan.search_chunks(files, **options)


def write(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks to Parquet below ``path``, exactly once, until all files that are there are through."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
