"""How many texts travel to Python at once, and what a worker keeps afterwards."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session's record batches to ``ROWS`` rows at most, unless they are smaller.

    Spark's default of 10,000 rows means tens of megabytes of text in each of several buffers of a task. Spark also bounds a
    batch's bytes, so very long texts come in batches of few rows.
    """
    if not 0 < int(spark.conf.get(SETTING)) <= ROWS:
        spark.conf.set(SETTING, str(ROWS))


def returning(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``task``, which gives freed memory back to the machine when it ends: workers wait for the next task with little."""

    @wraps(task)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Freed memory goes back to the machine now."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
