"""Maps over Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch: a worker holds a few batches, whatever the length of the texts.
BATCH_BYTES = 4 << 20
#: Spark's own value of the setting, which stands for no choice of the caller.
UNSET_BYTES = "67108864b"


def _give_back() -> None:
    """Return freed memory to the system: workers live on while other stages need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bound(spark: SparkSession) -> None:
    """Arrow batches of the session, those of pandas functions too, get their bound in bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == UNSET_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded size; a task gives its memory back at its end.

    Spark has no bound for a single call, so the session's is set, unless the caller has set one.
    """
    bound(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)
