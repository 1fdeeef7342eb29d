"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.session import ship_package

#: ASCII upper to lower case, for ``str.translate`` and ``bytes.translate``.
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
LOWER_BYTES = bytes(LOWER.get(i, i) for i in range(256))

#: Broadcast bound in bytes for lookups whose size is measured first.
BROADCAST_BYTES = 64 << 20


#: Rows of an Arrow batch. Texts are long, and a batch stands in the executor and in its Python worker at once.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Python workers of the session's jobs can import the package, and get batches of bounded size."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, in a prepared session."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def give_back() -> None:
    """At the end of a task: its worker serves other tasks, so free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which gives memory back after its last batch."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def map_rows(df: DataFrame, schema: str, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` where ``build`` makes the per-task function once per task, inside the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(tidy(run), schema)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty text."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [v if v is not None else "" for v in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def broadcast_within(df: DataFrame, rows: int, row_bytes: int, most: int | None = None) -> DataFrame:
    """Broadcast hint if ``rows * row_bytes`` is within the bound; otherwise a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= (BROADCAST_BYTES if most is None else most) else df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written.

    The context cleaner removes them once the driver has collected the finished plans, which a driver
    with little garbage does late; the shuffles of several steps would stand on the disks together.
    """
    for _ in range(2):  # what the first collection finds is let go by the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
