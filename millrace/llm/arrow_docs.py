"""Arrow batches of documents as byte strings, in slices of bounded size."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that a worker takes at once, unless one document alone has more.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch between Spark and a worker: thousands of long texts must not come at once.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to the above; lower ones stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.match(r"-?\d+", spark.conf.get(name))[0])
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def release() -> None:
    """Give the worker's free memory back to the system: workers live on while later stages need the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def frugal(run: Callable) -> Callable:
    """``run`` for mapInArrow, with release() at the end of its task."""

    @wraps(run)
    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return batches_of


def frugal_group(reduce: Callable) -> Callable:
    """``reduce`` for applyInArrow, with release() after each group."""

    @wraps(reduce)
    def of_group(table: pa.Table) -> pa.Table:
        try:
            return reduce(table)
        finally:
            release()

    return of_group


def frugal_cogroup(run: Callable) -> Callable:
    """``run`` for applyInArrow on two tables, with release() after each pair of groups."""

    @wraps(run)
    def of_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return of_groups


def utf8(column: pa.Array) -> list[bytes]:
    """The values as bytes; null becomes the empty string."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches whose texts sum to ``most`` bytes or that have one row."""
    for batch in batches:
        column = batch.column(text)
        start = held = 0
        for i in range(batch.num_rows):
            size = len(column[i].as_buffer() or b"") if column[i].is_valid else 0
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
