"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarnspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when this driver ends in order."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session has gone: the folder's owner cleans up
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: its plan starts from a scan, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """df with places 0, 1, ... in the order of key, and its number of rows. Ranges of key are sorted apart and written;
    only their sizes, a row a range, are summed in one task."""
    local = F.monotonically_increasing_id()
    parts = materialised(df.repartitionByRange(key).sortWithinPartitions(key).select("*", F.shiftright(local, 33).alias("_part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).select(*df.columns, name), parts.count()
