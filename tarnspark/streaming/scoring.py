"""Continuous scoring: request bodies in, verdicts out. Stateless: each micro-batch is parsed, vectorised and searched as a
batch against any index, so late or repeated requests need no care and a failed batch is simply run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnspark.functions.vectors import quantised
from tarnspark.operators.decisions import decided, fail_safe
from tarnspark.operators.index import Index
from tarnspark.operators.requests import parsed, request_features
from tarnspark.schema import DIMS, NEIGHBOURS


def score_bodies(bodies: DataFrame, index: Index, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame:
    """(id, body) -> (id, fraud_count, fraud_score, approved); bodies that cannot be scored are denied."""
    p = parsed(bodies)
    floats = p.filter("ok").select("id", *request_features())
    queries = floats.select("id", F.array(*[quantised(F.col(f"f{d}")) for d in range(DIMS)]).alias("vec"))
    joined = p.select("id", "ok").join(index.counts(queries, k, leave_self), "id", "left")
    return decided(joined.select("id", fail_safe(F.col("fraud_count"), F.col("ok")).alias("fraud_count")), k)


def stream_bodies(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of (id, body) from files of JSON lines {"id": ..., "body": ...}."""
    return spark.readStream.schema("id long, body string").option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_stream(bodies: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, leave_self: bool = False) -> StreamingQuery:
    """Starts the scoring of a stream; sink gets each batch's verdicts and its number, to write them idempotently."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(score_bodies(rows, index, leave_self=leave_self), number)

    writer = bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def verdict_files(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, replacing what an earlier attempt left."""
    return lambda verdicts, number: verdicts.write.mode("overwrite").parquet(f"{path}/batch={number}")
