"""Memory of Python workers. Spark hands a worker from task to task, also of other stages, and counts none of its memory."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch on its way to a worker; by rows alone, ten thousand texts or lists of shingles would go at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at `BATCH_BYTES`, besides at the rows it is set to."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def let_go() -> None:
    """What packing's tasks have remembered in this worker goes, and unused memory back to the system."""
    # The package is shipped by value; only what workers import themselves lasts there from task to task.
    if tokens := sys.modules.get("pairlens.llm.tokens"):
        tokens.word_encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands its worker's memory back before and after."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)
        let_go()

    return task
