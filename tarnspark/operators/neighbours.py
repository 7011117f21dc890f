"""Nearest neighbours under squared Euclidean distance of quantised vectors, ties to the lower ref_id.

Tables: references (ref_id long, vec array<int>, other columns), queries (id long, vec array<int>). Results are rows
(id, rank, ref_id, dist, other columns). All distances are exact integers: products of quantised values stay below 2**53 in
double matrix products for up to some 20 million dimensions' worth of squares.

One bounded block of queries meets the references in a stream over them; more queries meet them through boxes, as those of
cell indexes do (operators/boxes.py). Each task keeps the k best of each query it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.schema import NEIGHBOURS

#: Queries of one block: so many are broadcast for a single pass over the references; more stay on the executors.
QUERY_BLOCK = 4096
#: Queries and references that a step compares; a box holds some PACK_ROWS references.
PACK_QUERIES, PACK_ROWS = 512, 2048
#: Packs of a box's references, and queries of a box, that one task takes.
SALT_PACKS, HELD_QUERIES = 16, 65_536


@dataclass(frozen=True)
class Sizes:
    """PACK_QUERIES, PACK_ROWS, SALT_PACKS and HELD_QUERIES of a search."""

    queries: int
    rows: int
    packs: int
    held: int


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long integer lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of candidate rows (id, ref_id, dist, ...), with rank."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "ref_id"))).filter(F.col("rank") <= k)


class Best:
    """The k nearest of the references seen so far, for some queries: only references as near as a query's k-th best so far
    (or `limit`, where that is known) are looked at again."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, leave_self: bool, limit: np.ndarray | None = None) -> None:
        self.ids, self.points, self.k, self.leave_self = ids, points, k, leave_self
        self.own, self.limit = (points * points).sum(1), np.full(len(ids), np.inf) if limit is None else limit.astype(float)
        self.row, self.ref, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, refs: np.ndarray, x: np.ndarray) -> None:
        d = self.own[:, None] + (x * x).sum(1) - 2 * (self.points @ x.T)
        if self.leave_self:
            d[self.ids[:, None] == refs] = np.inf
        if (self.limit >= 2.0**62).any() and d.shape[1] >= self.k:
            self.limit = np.minimum(self.limit, np.partition(d, self.k - 1, 1)[:, self.k - 1])
        at, col = np.nonzero((d <= self.limit[:, None]) & np.isfinite(d))
        if not len(at):
            return
        row, ref, dist = np.concatenate([self.row, at]), np.concatenate([self.ref, refs[col]]), np.concatenate([self.dist, d[at, col]])
        order = np.lexsort((ref, dist, row))
        row, ref, dist = row[order], ref[order], dist[order]
        first = np.searchsorted(row, np.arange(len(self.ids) + 1))
        kept = np.arange(len(row)) - first[row] < self.k
        self.row, self.ref, self.dist = row[kept], ref[kept], dist[kept]
        first = np.searchsorted(self.row, np.arange(len(self.ids) + 1))
        full = np.flatnonzero(np.diff(first) == self.k)
        self.limit[full] = np.minimum(self.limit[full], self.dist[first[full] + self.k - 1])

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.ids[self.row]), pa.array(self.ref), pa.array(self.dist.astype(np.int64))], names=["id", "ref_id", "dist"])


_PAIR = "id long, ref_id long, dist long"


def _scan(ids: np.ndarray, points: np.ndarray, k: int, leave_self: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, points, k, leave_self)
        for b in batches:
            for lo in range(0, b.num_rows, PACK_ROWS):
                part = b.slice(lo, PACK_ROWS)
                best.add(part.column(0).to_numpy(), matrix(part.column(1)))
        yield best.rows()

    return run


def in_boxes(references: DataFrame):
    """The references in boxes (operators/boxes.py)."""
    from tarnspark.operators.boxes import Boxed

    return Boxed(references.select("ref_id", "vec"), Sizes(PACK_QUERIES, PACK_ROWS, SALT_PACKS, HELD_QUERIES))


def nearest(queries: DataFrame, references: DataFrame, k: int = NEIGHBOURS, leave_self: bool = False, block: int = QUERY_BLOCK, boxes: Callable | None = None) -> DataFrame:
    """Exact k nearest of every query. Up to `block` queries are broadcast, and each partition of the references, streamed
    once and not shuffled, keeps its own k best, so that tasks times queries times k rows meet in the final ranking, whatever the
    number of references. More queries search the references in boxes on the executors. A query with the ref_id of a
    reference can be told to leave it out. boxes() gives the references in boxes, for callers that search them again."""

    if k < 1:
        raise ValueError("k must be positive")
    some = queries.select("id", "vec").limit(block + 1).toArrow()
    if not some.num_rows:
        pairs = references.sparkSession.createDataFrame([], _PAIR)
    elif some.num_rows <= block:
        rows = some.sort_by("id").combine_chunks()
        pairs = references.select("ref_id", "vec").mapInArrow(_scan(rows.column("id").to_numpy(), matrix(rows.column("vec").combine_chunks()), k, leave_self), _PAIR)
    else:
        pairs = (boxes() if boxes else in_boxes(references)).search(queries, k, leave_self)
    return with_columns(ranked(pairs, k), references)


def with_columns(found: DataFrame, references: DataFrame) -> DataFrame:
    """Ranked pairs with the other columns of their references."""
    extra = [c for c in references.columns if c not in ("ref_id", "vec", "cell", "cell_dist")]
    return found.join(references.select("ref_id", *extra), "ref_id").select("id", "rank", "ref_id", "dist", *extra) if extra else found.select("id", "rank", "ref_id", "dist")


def listed(neighbours: DataFrame) -> DataFrame:
    """Per query its neighbours in order: arrays of ids and distances, and the distance of the last."""
    one = F.array_sort(F.collect_list(F.struct("rank", "ref_id", "dist")))
    return neighbours.groupBy("id").agg(one.alias("n")).select("id", F.col("n.ref_id").alias("ref_ids"), F.col("n.dist").alias("dists"), F.array_max("n.dist").alias("kth"))


def constant(queries: DataFrame, count: int = 2) -> DataFrame:
    """A stand-in index for pipeline tests: every query has the same count."""
    return queries.select("id", F.lit(count).alias("fraud_count"))
