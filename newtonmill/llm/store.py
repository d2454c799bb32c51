"""Scratch tables, by which every operator here cuts lineage, and the bounds of Arrow batches."""

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import scratch as shared
from ..scratch import drop, scratch

__all__ = ["drop", "limits", "save", "scratch", "small"]

#: Rows and bytes that a kernel works on at a time.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def small(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of bounded size, whatever limits the session has when the plan runs; a row alone may be larger."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * most / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


@contextmanager
def limits(spark: SparkSession, rows: int = BATCH_ROWS, most: int = BATCH_BYTES):
    """Small Arrow batches between the JVM and Python for what runs inside, and the session's own limits again behind it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    own = [spark.conf.get(n) for n in names]
    for n, value in zip(names, (rows, most)):
        spark.conf.set(n, str(value))
    try:
        yield
    finally:
        for n, value in zip(names, own):
            spark.conf.set(n, value)


def save(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df written to the scratch folder and read again, in small Arrow batches."""
    with limits(df.sparkSession, rows):
        return shared.save(df)
