"""Cell indexes over quantised vectors: inverted-file cells around centroids, box cells by sliding-midpoint splits, and
searches that probe some cells or prove that the others cannot matter.

A cell table holds at most MAX_CELLS rows, so it may be collected and broadcast whatever the number of references.
References carry `cell`; probed cells are searched through boxes inside them (operators/boxes.py), so that their members
count without all being compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.scalars import uniform
from tarnspark.operators.boxes import Boxed, splits
from tarnspark.operators.neighbours import HELD_QUERIES, PACK_QUERIES, PACK_ROWS, SALT_PACKS, Sizes, matrix, nearest, ranked, with_columns
from tarnspark.schema import DIMS, NEIGHBOURS
from tarnspark.storage import materialised

MAX_CELLS = 4096
#: Rows of the sample on which splits and centroids are fitted.
SAMPLE = 50_000


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, those of least seeded hash: the same on every run and engine."""
    return rows.orderBy(uniform(F.col(key), f"{seed}-sample"), key).limit(n)


def seed_centroids(references: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n lowest ref_ids."""
    _check_cells(n)
    return matrix(references.orderBy("ref_id").limit(n).select("vec").toArrow().column("vec").combine_chunks())


def kmeans_centroids(references: DataFrame, n: int, iterations: int = 10, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """Centroids by k-means|| and Lloyd steps on a sample, rounded to the quantised grid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    _check_cells(n)
    points = sample_rows(references, "ref_id", max(8 * n, sample)).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=n, maxIter=iterations, seed=seed, initMode="k-means||").fit(points)
    return np.unique(np.floor(np.array(model.clusterCenters()) + 0.5), axis=0)


def lloyd(references: DataFrame, centroids: np.ndarray, iterations: int = 1) -> np.ndarray:
    """Centroids after Lloyd steps over all references, rounded to the quantised grid; empty cells keep theirs. Only sums
    (a row a cell and dimension) reach the driver."""
    for _ in range(iterations):
        sums = centroid_sums(assigned(references.select("ref_id", "vec"), centroids)).toArrow()
        cell, dim = (sums.column(c).to_numpy().astype(int) for c in ("cell", "dim"))
        moved = centroids.astype(float).copy()
        moved[cell, dim] = np.floor(sums.column("total").to_numpy() / sums.column("n").to_numpy() + 0.5)
        centroids = moved
    return centroids


def _check_cells(n: int) -> None:
    if not 0 < n <= MAX_CELLS:
        raise ValueError(f"the number of cells must be between 1 and {MAX_CELLS}")


def _nearest_cells(centroids: np.ndarray, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (centroids * centroids).sum(1)
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                continue
            d = (x * x).sum(1)[:, None] + own - 2 * (x @ centroids.T)
            order = np.argsort(d, axis=1, kind="stable")[:, :n]  # stable: the lowest cell wins ties
            take = np.repeat(np.arange(len(x)), order.shape[1])
            yield pa.record_batch([b.column(0).take(pa.array(take)), pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel().astype(np.int64))], names=["id", "cell", "cell_dist"])

    return run


def probes(rows: DataFrame, centroids: np.ndarray, n: int = 1, key: str = "id") -> DataFrame:
    """(key, cell, cell_dist): the n nearest centroids of each row."""
    if not 1 <= n <= len(centroids):
        raise ValueError("the number of probes must be between 1 and the number of cells")
    return rows.select(F.col(key).alias("id"), "vec").mapInArrow(_nearest_cells(centroids, n), "id long, cell int, cell_dist long").withColumnRenamed("id", key)


def assigned(references: DataFrame, centroids: np.ndarray) -> DataFrame:
    """references with cell and cell_dist. One narrow pass, no shuffle."""
    names = [c for c in references.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (centroids * centroids).sum(1)
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("vec")))
            if not len(x):
                continue
            d = (x * x).sum(1)[:, None] + own - 2 * (x @ centroids.T)
            yield pa.record_batch([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1).astype(np.int64))], names=[*b.schema.names, "cell", "cell_dist"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in references.schema.fields)
    return references.mapInArrow(run, f"{schema}, cell int, cell_dist long").select(*names, "vec", "cell", "cell_dist")


def cell_stats(cells: DataFrame) -> DataFrame:
    """(cell, n, radius): members and squared radius of each non-empty cell."""
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("cell_dist").alias("radius"))


def boxes(cells: DataFrame) -> DataFrame:
    """(cell, n, lo, hi): the bounding box of each non-empty cell."""
    dims = len(cells.select("vec").first()["vec"]) if cells.take(1) else 0
    lows = [F.min(F.col("vec")[d]) for d in range(dims)]
    highs = [F.max(F.col("vec")[d]) for d in range(dims)]
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))


class Boxes:
    """Least distances to the members of cells, by their bounding boxes (cell, n, lo, hi)."""

    def __init__(self, box_table: DataFrame) -> None:
        rows = _few(box_table)
        self.cell, self.n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
        self.lo, self.hi = matrix(rows.column("lo").combine_chunks()), matrix(rows.column("hi").combine_chunks())

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sum((np.maximum(np.maximum(self.lo[:, d] - x[:, d : d + 1], x[:, d : d + 1] - self.hi[:, d]), 0) ** 2 for d in range(x.shape[1])), np.zeros((len(x), len(self.cell))))


class Balls:
    """The same by the triangle inequality, from centroids and (cell, n, radius): a little below the exact bound, as square
    roots are rounded."""

    def __init__(self, centroids: np.ndarray, stats: DataFrame) -> None:
        rows = _few(stats)
        self.cell, self.n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
        self.centroids, self.radius = centroids[self.cell], rows.column("radius").to_numpy().astype(float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d = np.maximum((x * x).sum(1)[:, None] + (self.centroids * self.centroids).sum(1) - 2 * (x @ self.centroids.T), 0)
        gap = np.sqrt(d) - np.sqrt(self.radius) - 1e-6
        return np.maximum(np.floor(np.where(gap > 0, gap * gap, 0)) - 1, 0)


def _few(table: DataFrame) -> pa.Table:
    """A table of cells on the driver, by cell."""
    rows = table.limit(MAX_CELLS + 1).toArrow().sort_by("cell").combine_chunks()
    if rows.num_rows > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return rows


def box_bounds(queries: DataFrame, box_table: DataFrame) -> DataFrame:
    """(id, cell, n, bound): a report of the least possible distance of each query to each cell's members. Searches
    compute bounds inside their kernels and pass on only the cells that matter."""
    bounds = Boxes(box_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            for a in range(0, len(x) if len(bounds.cell) else 0, 256):
                part = x[a : a + 256]
                take = pa.array(np.repeat(np.arange(a, a + len(part)), len(bounds.cell)))
                yield pa.record_batch([b.column(0).take(take), pa.array(np.tile(bounds.cell, len(part)).astype(np.int32)), pa.array(np.tile(bounds.n, len(part))), pa.array(bounds(part).ravel().astype(np.int64))], names=["id", "cell", "n", "bound"])

    return queries.select("id", "vec").mapInArrow(run, "id long, cell int, n long, bound long")


def _searched(bounds: Callable, need: int, epsilon: float, budget: int | None) -> Callable:
    """(id, vec) -> the cells of least bound that hold enough members; (id, vec, kth) -> the other cells to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, n = bounds.cell, bounds.n
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                d = bounds(matrix(part.column(1)))
                order = np.lexsort((np.broadcast_to(cell, d.shape), d), axis=1) if len(cell) else np.zeros(d.shape, int)
                ahead = np.cumsum(n[order], 1) - n[order]
                taken, stopped = ahead < need, np.zeros(part.num_rows, bool)
                if part.num_columns > 2:
                    kth = part.column(2).fill_null(2**62).to_numpy()[:, None].astype(float)
                    near = np.take_along_axis(d, order, 1)
                    matter = ~taken & (near <= kth)
                    taken = matter & (near <= kth * (1 - epsilon)) & (ahead < (budget if budget is not None else np.inf))
                    stopped = (matter & ~taken).any(1)
                row, col = np.nonzero(taken)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken.sum(1))).astype(np.int32)), pa.array(cell[order[row, col]].astype(np.int32)))
                yield pa.record_batch([part.column(0), lists, pa.array((n[order] * taken).sum(1)), pa.array(np.full(part.num_rows, len(cell))), pa.array(stopped)], names=["id", "cells", "visits", "checks", "stopped"])

    return run


_WORK = "id long, cells array<int>, visits long, checks long, stopped boolean"


def in_boxes(cells: DataFrame) -> Boxed:
    """The members of cells in boxes that do not cross them, for any number of searches."""
    return Boxed(cells, Sizes(PACK_QUERIES, PACK_ROWS, SALT_PACKS, HELD_QUERIES))


def _in_nearest(queries: DataFrame, boxes: Boxed, centroids: np.ndarray, n: int, k: int, leave_self: bool) -> DataFrame:
    wanted = probes(queries, centroids, n).groupBy("id").agg(F.collect_list("cell").alias("cells"))  # n numbers a query
    return ranked(boxes.search(queries.join(wanted, "id"), k, leave_self), k)


def probed(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, n: int, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame:
    """Approximate k nearest: exact among the members of the n nearest cells."""
    return with_columns(_in_nearest(queries, in_boxes(cells), centroids, n, k, leave_self), cells)


def pruned(queries: DataFrame, cells: DataFrame, bounds: Callable, k: int = NEIGHBOURS, leave_self: bool = False, epsilon: float = 0.0, budget: int | None = None, boxes: Boxed | None = None) -> tuple[DataFrame, DataFrame]:
    """k nearest by cells, and the work done (id, visits, checks, stopped).

    First the cells of least bound that hold enough members are searched; their k-th distance limits which other cells
    matter. A bound equal to it still counts: a member at that distance may win by its ref_id. With epsilon 0 and no budget
    the result is exact. Relaxed, cells are left out whose bound is above (1 - epsilon) times that distance, or before
    which, in the order of bounds, `budget` members lie; queries that such a cell could have mattered to are `stopped`.
    boxes: in_boxes(cells), where they are there already."""
    if not 0 <= epsilon < 1:
        raise ValueError("epsilon must be at least 0 and below 1")
    need, boxes = k + int(leave_self), boxes or in_boxes(cells)
    vectors = queries.select("id", "vec")
    begun = queries.select("id", "vec").mapInArrow(_searched(bounds, need, 0.0, None), _WORK)
    begun = materialised(begun, "begun")
    early = materialised(_best(boxes.search(vectors.join(begun.select("id", "cells"), "id"), k, leave_self), k), "early")
    limited = vectors.join(kth_distance(early, k), "id", "left").select("id", "vec", "kth")
    rest = materialised(limited.mapInArrow(_searched(bounds, need, epsilon, budget), _WORK), "rest")
    late = boxes.search(limited.join(rest.filter(F.size("cells") > 0).select("id", "cells"), "id"), k, leave_self, tighten=budget is None)  # the k-th distance in the first cells may be loose
    work_done = begun.select("id", "visits", F.lit(0).cast("long").alias("checks"), "stopped").unionByName(rest.drop("cells"))
    return with_columns(ranked(early.unionByName(late), k), cells), merged_work(work_done)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    return ranked(pairs, k).drop("rank")


def merged_work(counters: DataFrame) -> DataFrame:
    """(id, visits, checks, stopped) of all passes of a query: work adds up, and what stopped once stays so."""
    return counters.groupBy("id").agg(F.sum("visits").alias("visits"), F.sum("checks").alias("checks"), F.max("stopped").alias("stopped"))


def early_done(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, n: int, enough: int, k: int = NEIGHBOURS, leave_self: bool = False, boxes: Boxed | None = None) -> tuple[DataFrame, DataFrame]:
    """Approximate k nearest that stops after the nearest cell where the k-th distance is already at most `enough`, else
    takes the n nearest cells, of which the first is not searched again and bounds the others; and (id, stopped).
    boxes: in_boxes(cells), where they are there already."""
    boxes = boxes or in_boxes(cells)
    first = materialised(_in_nearest(queries, boxes, centroids, 1, k, leave_self), "nearest-cell").drop("rank")
    state = queries.select("id").join(kth_distance(first, k), "id", "left").select("id", "kth", F.coalesce(F.col("kth") <= enough, F.lit(False)).alias("stopped"))
    state = materialised(state, "state")
    order = F.array_sort(F.collect_list(F.struct("cell_dist", "cell")))  # n numbers a query
    others = probes(queries, centroids, n).groupBy("id").agg(order.alias("c")).select("id", F.expr("slice(c.cell, 2, size(c))").alias("cells")).filter(F.size("cells") > 0)
    more = queries.select("id", "vec").join(state.filter("not stopped").select("id", "kth"), "id").join(others, "id")
    found = ranked(first.unionByName(boxes.search(more, k, leave_self)), k)
    return with_columns(found, cells), state.select("id", "stopped")


def kth_distance(found: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, kth): the distance of the k-th of a query's neighbours (id, dist), null where there are fewer."""
    return found.groupBy("id").agg(F.when(F.count("*") >= k, F.max("dist")).alias("kth"))


def refined(counts: DataFrame, queries: DataFrame, references: DataFrame, k: int = NEIGHBOURS, label: str = "is_fraud", leave_self: bool = False, boxes: Boxed | None = None) -> DataFrame:
    """Approximate counts (id, fraud_count) with undecided ones (2 or 3 of 5) replaced by those of an exact search; where
    counts tell which searches `stopped`, only those. boxes: of the references, where they are there already; the k-th
    distance that queries may carry as `kth` then bounds that search."""
    from tarnspark.operators.decisions import votes

    undecided = F.col("fraud_count").isin(2, 3) & (F.col("stopped") if "stopped" in counts.columns else F.lit(True))
    marked = counts.select("id", "fraud_count", undecided.alias("refined"))
    again = queries.join(marked.filter("refined").select("id"), "id", "left_semi")
    exact = votes(nearest(again, references, k, leave_self, boxes=(lambda: boxes) if boxes else None), again, label)
    return marked.filter("not refined").unionByName(exact.withColumn("refined", F.lit(True)))


def work(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """(id, cells, candidates) of a probe, from cell sizes alone."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    return probes(queries, centroids, n).join(sizes, "cell", "left").groupBy("id").agg(F.count("*").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def cell_offsets(cells: DataFrame, total_cells: int) -> DataFrame:
    """(cell, n, start): where each cell's members begin in cell order. One number a cell, of which there are few."""
    from pyspark.sql import Window

    sizes = cells.sparkSession.range(total_cells).select(F.col("id").cast("int").alias("cell")).join(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def build_report(cells: DataFrame, total_cells: int) -> DataFrame:
    """One row: empty cells, and least, median, 99th percentile, greatest and mean size; rank floor(n * p), no
    interpolation."""
    sizes = cells.sparkSession.range(total_cells).select(F.col("id").cast("int").alias("cell")).join(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list("n")).alias("s"))  # one number a cell, of which there are few
    at = lambda p: F.col("s")[min(total_cells - 1, int(total_cells * p))]
    return listed.select(
        F.size(F.filter("s", lambda x: x == 0)).cast("long").alias("empty_cells"), F.col("s")[0].alias("min_size"), at(0.5).alias("p50_size"), at(0.99).alias("p99_size"),
        F.col("s")[total_cells - 1].alias("max_size"), (F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(float(total_cells))).alias("mean_size"),
    )


def centroid_sums(cells: DataFrame) -> DataFrame:
    """(cell, dim, total, n): what one Lloyd step divides."""
    return cells.select("cell", F.posexplode("vec").alias("dim", "x")).groupBy("cell", "dim").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def fit_boxes(references: DataFrame, leaves: int = 64, sample: int = SAMPLE) -> list[tuple]:
    """A binary tree of splits fitted on a sample: nodes (dim, threshold, left, right), leaves (cell,)."""
    _check_cells(leaves)
    points = matrix(sample_rows(references, "ref_id", sample).select("vec").toArrow().column("vec").combine_chunks())
    return splits(points, leaves)


def boxed(references: DataFrame, nodes: list[tuple]) -> DataFrame:
    """references with the box cell that the fitted tree gives them."""

    def tree(at: int) -> F.Column:
        node = nodes[at]
        return F.lit(node[0]) if len(node) == 1 else F.when(F.col("vec")[node[0]] < node[1], tree(node[2])).otherwise(tree(node[3]))

    return references.withColumn("cell", tree(0))


assert DIMS * (2 * 10_000) ** 2 < 2**53
