"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


# Workers are used again by later stages; what a stage frees goes back to the system.
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):  # without glibc, its own ways hold
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD: arrays from 2 MB on are mapped for themselves, and it no longer grows
    _libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or that set by ``setCheckpointDir``.

    Where there is neither, a temporary folder is made if driver and tasks are one process (local tests); a cluster must
    name a folder, as executors do not see each other's disks.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed once and written to the shared folder: its lineage is cut and its rows survive lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "kept")
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups keep the writers small
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes frames that ``kept`` wrote, once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (one more entry than rows); nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text is about ``most_bytes`` long, one row at least."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
