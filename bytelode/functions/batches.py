"""Python stages over content: batches are bounded in bytes, as one row may hold a whole file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

RECORDS, BYTES = 1024, 64 << 20


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return df.mapInArrow(function, schema)
