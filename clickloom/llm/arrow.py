"""Arrow batches bounded by bytes, since texts may be very long."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A batch of more rows than one is closed at so many bytes.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Give freed memory back to the system, which Arrow's pool and glibc's malloc would hold for as long as the process lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES; the session keeps this limit, as plans are run later.

    Each task gives its memory back when it ends, since Python's processes stay for the next ones.
    """
    df.sparkSession.conf.set(_LIMIT, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)
