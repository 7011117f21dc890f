"""Stored cell indexes: references partitioned by cell as Parquet, so that a probe reads the cells it asks for and only the
columns it uses, with each cell's size and squared radius and a versioned description beside them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "tarnspark-cells-2"
#: Rows of a file of one cell: larger cells are written by several tasks.
FILE_ROWS = 1 << 20


def write_index(cells: DataFrame, path: str, centroids: np.ndarray | None = None) -> None:
    """Rows of one cell lie together, clustered by the shuffle on cell and sorted within files."""
    from tarnspark.operators.cells import cell_stats

    cell_stats(cells if "cell_dist" in cells.columns else cells.withColumn("cell_dist", F.lit(None).cast("long"))).coalesce(1).write.parquet(f"{path}/stats")
    files = cells.sparkSession.read.parquet(f"{path}/stats").select(F.col("cell").alias("c"), F.ceil(F.col("n") / FILE_ROWS).alias("files"))
    dealt = cells.join(F.broadcast(files), F.col("cell") == F.col("c")).withColumn("file", F.pmod(F.xxhash64("ref_id"), F.col("files")))  # a row a cell
    dealt.repartition("cell", "file").sortWithinPartitions("cell", "ref_id").select(*cells.columns).write.partitionBy("cell").parquet(f"{path}/cells")
    dims = len(cells.select("vec").first()["vec"])
    meta = {"format": FORMAT, "dims": dims, "columns": cells.columns, "centroids": None if centroids is None else centroids.astype(int).tolist()}
    cells.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_index(spark: SparkSession, path: str, dims: int | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """Cells and centroids; another format or width is an error."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("format") != FORMAT:
        raise ValueError(f"not a {FORMAT} index: {meta.get('format')}")
    if dims is not None and meta["dims"] != dims:
        raise ValueError(f"index of {meta['dims']} dimensions, {dims} wanted")
    cells = spark.read.parquet(f"{path}/cells").select(*meta["columns"])
    return cells, None if meta["centroids"] is None else np.array(meta["centroids"], float)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(cell, n, radius) of each non-empty cell, as it was stored."""
    return spark.read.parquet(f"{path}/stats")


def build_index(spark: SparkSession, references_path: str, out: str, cells: int, n: int = 0) -> None:
    """Reference JSON to a stored inverted-file index; n > 0 takes the first n records only."""
    from tarnspark.operators.cells import assigned, kmeans_centroids
    from tarnspark.sources.references import first_references, quantised_references, read_references

    rows = read_references(spark, references_path)
    rows = quantised_references(first_references(rows, n) if n else rows)
    centroids = kmeans_centroids(rows, cells)
    write_index(assigned(rows, centroids), out, centroids)
