"""Helpers of this subpackage."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.session import ship_package, written

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "arrow_map", "largest", "lower_ascii", "rows_at_a_time", "sized", "table", "written"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: For bytes.translate: lower-cases A-Z and leaves every other byte, also those of multi-byte characters.
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; NULL becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if its rows, which are counted, are at most ``most``; else Spark joins by a shuffle.

    For narrow tables that are read from a written result, so that counting costs little.
    """
    return F.broadcast(df) if df.count() <= most else df


def largest(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of ``df`` whose positive ``column`` is above a value that at most ``most`` rows reach.

    The value comes from a histogram by sixteenths of an octave, some hundred rows, so that no task and not the driver sees
    more than the chosen rows. ``df`` is read twice.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * 16)
    held, least = 0, None
    for row in sorted(df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("held")).collect(), reverse=True):
        held += row["held"]
        if held > most:
            break
        least = row["step"]
    return df.filter(step >= least if least is not None else F.lit(False))


def _give_back() -> None:
    """Returns what this worker process has freed to the system, so that its next tasks and the executor can have it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package sent to the workers; a worker process does not keep the memory of a task that is done."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(task, schema)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_setting = threading.RLock()


@contextmanager
def rows_at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Workers get at most ``rows`` rows in a batch from the jobs that run within; a plan that runs later is not held to it.

    Else a task's whole partition, up to 10,000 rows, lies in one batch, both in the executor's memory outside its heap and in the worker's.
    The setting is the session's, so threads that want it take turns.
    """
    with _setting:
        before = spark.conf.get(_BATCH_ROWS)
        spark.conf.set(_BATCH_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
        try:
            yield
        finally:
            spark.conf.set(_BATCH_ROWS, before)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; NULL becomes empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
