"""What the operators share: tables in the cluster's shared folder, and reading inputs."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder for a local session that names none. A cluster has to name one.
LOCAL_SHARED = "/tmp/checkpoints"

#: Rows of a table of a few numbers that is broadcast at most (24 MB of three).
SMALL = 500_000

#: Bytes that a Python worker is sent at once, and rows that are read from Parquet at once: rows may be long.
BATCH, ROWS = 4 << 20, 512
_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH), "spark.sql.parquet.columnarReaderBatchSize": str(ROWS)}
#: Bytes of a Parquet row group, which a task holds in memory while it writes.
ROW_GROUP = 16 << 20

#: A word: a run of characters other than the space and the ASCII controls 09 to 0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siftline-{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs the tasks that were running, not the plan so far. While it is
    written, Python workers are sent BATCH bytes and Parquet is read ROWS rows at a time, so long
    texts don't add up.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


#: Paths of ``materialise``, in order, of tables that may still be there.
_WRITTEN: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, when left without an error, the tables written meanwhile, but those put in the list that it gives."""
    before, kept = len(_WRITTEN), []
    yield kept
    held = {getattr(df, "_siftline_path", None) for df in kept}
    for path in _WRITTEN[before:]:
        if path not in held:
            _delete(spark, path)
    _WRITTEN[before:] = [path for path in _WRITTEN[before:] if path in held]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    path = getattr(df, "_siftline_path", None)
    if path:
        _delete(df.sparkSession, path)


def small(df: DataFrame, most: int = SMALL, rows: int | None = None) -> DataFrame:
    """``df``, a table of few columns of numbers, to be broadcast if it has at most ``most`` rows.

    A larger one stays as it is, and Spark joins it by a shuffle. ``rows``, if known, is what it has
    at most; else they are counted.
    """
    if rows is None or rows > most:
        rows = df.limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Python workers are sent BATCH bytes at once from now on, unless the session has a limit.

    For long texts in a plan that the caller runs, and not ``materialise``: Spark's own limit is 64 MB, which
    a task holds on both sides, and twice over in the JVM while the buffer grows.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH))
    return df


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, after which the worker gives back the memory it is done with.

    A worker waits for the next task, of another stage perhaps, and would hold all it ever had.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
        if trim:
            trim(0)

    return whole


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_keys(text: Column) -> list[Column]:
    """(k1, k2): 128 bits that stand for a text; of 64 bits some texts of a large corpus would share theirs."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage, which deletes the shuffle files of finished jobs.

    They stay on the executors' disks until then, and a driver that is idle collects nothing.
    """
    for _ in range(2):  # what Python has let go reaches the driver's JVM a little later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def relieve(spark: SparkSession) -> int:
    """Let the executors collect their garbage, which gives the memory of their heaps back to the machine; how many tasks did.

    A heap stays as large as shuffles made it, while the Python workers of the next step take memory beside it.
    """
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that every executor has one
    return len(spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

