"""Helpers that the operators of this folder share: tables, Arrow batches and the shared work folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fossick.llm import bytehash

#: Text bytes that one Arrow batch or one vectorised step may hold, but for a single longer text. A step holds some ten
#: arrays of 8 bytes for each of them, in every worker of an executor.
BATCH_BYTES = (1 << 20) - 1
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, where the session leaves them unbounded: rows of long texts else fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "2147483647")) >= 2147483647:
        spark.conf.set(key, str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only where it is unset and all tasks run in this
    process, as in tests, a local one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fossick-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/fossick-work"


_tables: set[str] = set()


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet into the shared folder and reads it back: this cuts its lineage and survives lost executors.

    ``remove_table`` removes it once nothing reads it any more; what is left then goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_remove_all)
    _tables.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_table(spark: SparkSession, path: str) -> None:
    _delete(spark._jvm, path)
    _tables.discard(path)


def _delete(jvm, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(p, True)


def _remove_all() -> None:
    """At the driver's end. A driver that is killed leaves its tables under fossick-work of the shared folder."""
    with contextlib.suppress(Exception):
        for path in _tables:
            _delete(SparkContext._gateway.jvm, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; nulls count as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    bufs = arr.buffers()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def give_back() -> None:
    """Returns the memory that a task has taken: workers stay for the next tasks, also those of other stages."""
    bytehash.forget()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of at most ``most`` text bytes; a longer text is a run of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = string_buffers(b.column(b.schema.get_field_index(text)))
        i, n = 0, b.num_rows
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
            j = min(n, max(j, i + 1))
            yield b.slice(i, j - i)
            i = j
    give_back()
