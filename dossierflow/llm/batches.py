"""Arrow batches in tasks: rows of a batch in small slices, rows out by schema."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: bytes of text that are worked on at once; a longer text is a slice of its own
SLICE_BYTES = 1 << 19


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, empty for null."""
    return texts.cast(pa.large_binary()).fill_null(b"")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets) of runs of rows of about ``limit`` bytes."""
    raw = as_bytes(texts)
    if len(raw) == 0:
        return
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(raw))
        yield lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def freeing(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving freed memory back to the system when its task ends:
    Python workers live on between stages, and an executor holds several of them."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not this C library
                pass

    return wrapped


@contextmanager
def small_batches(spark: SparkSession, limit: int):
    """While it lasts, tasks that are run get Arrow batches of about ``limit`` bytes: what is held of them,
    in the JVM and in Python, is bounded where single rows have megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{limit}b")
    try:
        yield
    finally:
        spark.conf.unset(key)
        if before is not None and spark.conf.get(key, None) != before:
            spark.conf.set(key, before)
