"""What the operators of this subpackage share: scratch tables in the cluster's shared folder, batching of Arrow
columns into bounded pieces, and byte-level views of texts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a single longer text forms a step of its own.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and Python: bounds a worker's memory when texts are long.
BATCH_BYTES = 8 << 20
_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; a temporary one is set only where none is (local tests)."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="tarnspark-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def released() -> None:
    """Gives the memory that an earlier step used in the driver back to the system: Python's, Arrow's and the JVM's, whose
    collection also lets go of that step's broadcasts."""
    gc.collect()
    trim()
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that this process has freed, but still holds, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc: nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run over a task's batches, in a worker that does not sit on the memory of the task before it, nor of this one."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return lean


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when this driver ends in order."""
    path = f"{shared_dir(spark)}/tarnspark-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone: the folder's owner cleans up
        pass


def forget(spark: SparkSession, path: str) -> None:
    """Removes a scratch path that nothing reads any more."""
    _remove(spark, path)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder (under a name, or at a scratch path) and read again: cuts lineage, survives lost
    executors."""
    spark = df.sparkSession
    path = name if "/" in name else scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session small: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def doc_key(doc_id: str = "doc_id") -> Column:
    """Non-null stand-in for doc_id in joins."""
    return F.coalesce(F.col(doc_id), F.lit(-(2**63)))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and where each went: names that an operator adds cannot clash with theirs."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column without nulls, without a copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts hold about limit bytes; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], starts[i] + 1, ... lengths[i] of them, for each i."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) that spreads uint64 values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h
