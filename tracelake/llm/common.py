"""What several operators need: tables, the shared folder, batches of texts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent, a local session (all of whose tasks run on this
    machine) takes a temporary folder and a cluster is refused one. The session's
    setting itself is never changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'tracelake-' + spark.sparkContext.applicationId)}"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter by which rows that are surely not needed are skipped.
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, bit: Column) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits, set at the ids' places; its size does not depend on the data."""
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of MurmurHash3), on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(lengths: list[int], most: int):
    """Ranges of consecutive items that hold ``most`` units at most, or one item."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


#: What lets go of tables that operators keep in a Python worker from task to task.
TABLES: list = []


def returned() -> None:
    """Gives memory that is not in use back to the system, which a worker would keep for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def dropped() -> None:
    """Lets go of all that operators keep in this worker."""
    for drop in TABLES:
        drop()


def lean(run):
    """``run``, a function on batches, in a worker that holds no operator's tables meanwhile and no memory for it afterwards.

    Workers outlive tasks and stages, and count with their executor.
    """

    def leaner(batches):
        dropped()
        try:
            yield from run(batches)
        finally:
            returned()

    return leaner
