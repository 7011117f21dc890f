"""Labelled reference sets and payload banks."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions.scalars import padded, uniform
from tarnspark.functions.vectors import quantised_vector
from tarnspark.schema import DIMS, REFERENCE
from tarnspark.storage import numbered

EXPECTED_REFERENCES = 3_000_000
MAX_PAYLOADS, MAX_PAYLOAD_BYTES = 100_000_000, 1 << 20


def is_fraud(label: Column) -> Column:
    """Exactly "fraud"; anything else, null included, is legitimate."""
    return F.coalesce(label == "fraud", F.lit(False))


def read_references(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(ref_id, vector array<float> of 14, is_fraud) of a JSON array, gzipped or not; unknown fields are skipped.

    One JSON array cannot be split, so this is a one-time conversion: write the result as Parquet. ref_id is the record's
    position, which a single file keeps."""
    raw = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    out = raw.select(F.monotonically_increasing_id().alias("ref_id"), padded(F.coalesce("vector", F.array().cast("array<double>")), DIMS).cast("array<float>").alias("vector"), is_fraud(F.col("label")).alias("is_fraud"))
    if expected is not None and (n := out.count()) != expected:
        logging.getLogger(__name__).warning("expected %d references, found %d", expected, n)
    return out


def write_references(references: DataFrame, path: str) -> None:
    """(vector, is_fraud) as gzipped JSON arrays, one a partition: what read_references reads."""
    record = F.to_json(F.struct("vector", F.when(F.col("is_fraud"), "fraud").otherwise("legit").alias("label")))
    rows = references.select(record.alias("record"), F.spark_partition_id().alias("part"))
    arrays = rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").option("compression", "gzip").text(path)


def first_references(references: DataFrame, n: int) -> DataFrame:
    """The n references of lowest ref_id; fewer are an error."""
    if n <= 0:
        raise ValueError("n must be positive")
    out = references.orderBy("ref_id").limit(n)
    if (found := out.count()) < n:
        raise ValueError(f"{n} references wanted, {found} found")
    return out


def quantised_references(references: DataFrame) -> DataFrame:
    return references.select("ref_id", quantised_vector(F.col("vector")).alias("vec"), "is_fraud")


def write_payloads(bodies: DataFrame, path: str, body: str = "body") -> None:
    """One JSON body a line."""
    bodies.select(F.col(body).alias("value")).write.text(path)


def read_payloads(spark: SparkSession, path: str, max_rows: int = MAX_PAYLOADS, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """(body) of a written bank; a bank beyond the limits is refused, not cut."""
    out = spark.read.text(path).select(F.col("value").alias("body"))
    n, longest = out.agg(F.count("*"), F.max(F.octet_length("body"))).first()
    if n > max_rows or (longest or 0) > max_bytes:
        raise ValueError(f"{n} payloads of up to {longest} bytes exceed the limits")
    return out


def sample_payloads(bodies: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n bodies drawn with replacement, the same on every run: draw i takes the row at a seeded hash of i."""
    rows, total = numbered(bodies, key, "_at")
    if not total:
        raise ValueError("nothing to draw from")
    draws = bodies.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), f"{seed}-draw") * total).cast("long").alias("_at"))
    return draws.join(rows, "_at").drop("_at")


def templates(spark: SparkSession) -> DataFrame:
    """(draw, body): sixteen fixed requests for when there is no bank."""
    from tarnspark.sources.templates import bodies

    return spark.createDataFrame(list(enumerate(bodies())), "draw long, body string")


def load_payloads(spark: SparkSession, path: str, max_rows: int = MAX_PAYLOADS) -> DataFrame:
    """The bank at path, or the templates if it cannot be read."""
    try:
        return read_payloads(spark, path, max_rows)
    except AnalysisException:  # nothing is there; a bank beyond the limits stays an error
        logging.getLogger(__name__).warning("no payloads at %s: using the templates", path)
        return templates(spark).select("body")


def choose_payloads(spark: SparkSession, source: str, path: str, n: int, seed: int = 42) -> DataFrame:
    """A sample of the bodies at path if that is asked for and there are any, else synthetic ones."""
    from tarnspark.sources.synthetic import requests

    if source == "sample":
        try:
            found = read_payloads(spark, path)
            return sample_payloads(found.withColumn("_key", F.xxhash64("body")), n, "_key", seed).select("draw", "body")
        except AnalysisException:
            logging.getLogger(__name__).warning("no payloads at %s: using synthetic ones", path)
    return requests(spark, n, seed).select(F.col("id").alias("draw"), "body")
