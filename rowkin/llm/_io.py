"""Shared folder, stage tables and Arrow text access used by every operator of the subpackage."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only in local mode where the setting is unset."""
    path = shared_folder(spark.sparkContext)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rowkin/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one in this many of all rows is hot; there are fewer hot keys than this.
HOT_SHARE = 4096


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has one row per key and the number ``n`` of the key's rows among ``total``.

    Hot keys, fewer than HOT_SHARE by their definition, are broadcast; the others meet in a shuffle in which no key has more
    than one in HOT_SHARE of all rows. ``rows`` is read three times, so it should be a stage table.
    """
    hot = F.broadcast(counted.filter(F.col("n") * HOT_SHARE > total))
    cold = rows.join(hot.select(*on), on, "left_anti").join(counted.filter(F.col("n") * HOT_SHARE <= total), on)
    return rows.join(hot, on).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _malloc_settings() -> None:
    """Let glibc map large arrays on their own, so that a reused Python worker gives them back when they are freed."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc alone has it
    if mallopt is not None:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with every array freed


_malloc_settings()


def release() -> None:
    """Give freed memory back to the system, which reused Python workers would otherwise keep between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of a batch whose ``column`` holds at most ``most_bytes`` bytes, or one row."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + n > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    yield batch.slice(at)
    release()
