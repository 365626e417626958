"""Tables that a multi-step job hands from step to step.

A step that is read more than once, or that ends an iteration, is written as Parquet to
the folder that all executors share (``spark.checkpoint.dir``). A lost executor then
costs the tasks it ran, never the lineage behind the table.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only where that is unset and all tasks
    run on one machine (tests) a temporary folder takes its place; on a cluster its absence
    is an error, as executors would write to their own disks."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_KEY, base)
    _MADE.append(f"{base.rstrip('/')}/wayfold-{uuid.uuid4().hex}")
    return _MADE[-1]


def keep(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` below ``folder`` and return the written table."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that were made within it. Whatever is read later
    must have been written to an older one."""
    before = len(_MADE)
    yield
    while len(_MADE) > before:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Spark hands so many rows to Python at once, for what is written within: tables of
    long texts then take little memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Unused memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(batches: Iterator) -> Iterator:
    """``batches`` of a Python task; after each, and at the end, unused memory goes back to the
    system. Workers live on from task to task, and what their allocators hold counts."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
    give_back()


def swept(spark: SparkSession) -> None:
    """Shuffle files of results that nobody holds any more go from the executors' disks; Spark
    deletes them once the driver has collected what stood for them."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
