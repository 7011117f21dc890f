"""Exact searches of many queries through box cells, inside the cells of an index or without one.

Splits fitted on a bounded sample deal the references to boxes of some PACK_ROWS rows, MAX_BOXES at most; every reference
lies in one box, and a box in one cell. A query first meets the boxes nearest to it that hold enough references; the k-th
distance found there bounds the others: a box whose bound is not above it still counts, as a reference at that distance
may win by its ref_id. Boxes meet their queries in an equi-join by sorting: queries and references of a box go to the same
task, references first. Neither rows nor results reach the driver, only a row a box.

Boxes of many references are split by `part`, to each of which the queries go, and boxes of many queries by `block`, to
each of which the references go: one hot box does not sit in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.operators.neighbours import Best, Sizes, matrix, ranked
from tarnspark.storage import materialised

MAX_BOXES = 4096
#: Rows of the sample on which splits are fitted.
SAMPLE = 65_536
#: Queries whose bounds a step computes.
STEP_QUERIES = 64


def splits(points: np.ndarray, leaves: int) -> list[tuple]:
    """A binary tree of splits: nodes (dim, threshold, left, right), leaves (number,). The widest dimension is cut at the
    middle of its range, moved so that neither side has under a ninth of the node's points."""
    heap = [(-len(points), 0, points)]
    nodes: list[tuple] = [()]
    count = 1
    while count < leaves and heap:
        _, at, p = heapq.heappop(heap)
        if len(p) < 2 or not np.ptp(p, 0).max():
            continue
        dim = int(np.ptp(p, 0).argmax())
        v = np.sort(p[:, dim])
        least = max(1, len(v) // 9)
        low = int(np.clip(np.searchsorted(v, (v[0] + v[-1]) / 2), least, len(v) - least))
        threshold = float(v[low]) if v[low] > v[0] else float(v[np.searchsorted(v, v[0], "right")])
        left = p[:, dim] < threshold
        nodes[at] = (dim, threshold, len(nodes), len(nodes) + 1)
        for side in (p[left], p[~left]):
            heapq.heappush(heap, (-len(side), len(nodes), side))
            nodes.append(())
        count += 1
    leaf = 0
    for k, node in enumerate(nodes):
        if not node:
            nodes[k] = (leaf,)
            leaf += 1
    return nodes


class _Forest:
    """A tree of splits for each cell; leaves are numbered through, and owner tells the cell of each."""

    def __init__(self, points: np.ndarray, cell: np.ndarray, cells: int, leaves: int) -> None:
        dim, cut, left, right, number, owner, self.root = [], [], [], [], [], [], []
        order = np.argsort(cell, kind="stable")
        own = np.split(points[order], np.searchsorted(cell[order], np.arange(1, cells)))
        for c in range(cells):
            at, first = len(dim), len(owner)
            self.root.append(at)
            for node in splits(own[c], leaves):
                inner = len(node) > 1
                dim.append(node[0] if inner else 0)
                cut.append(node[1] if inner else 0.0)
                left.append(at + node[2] if inner else -1)
                right.append(at + node[3] if inner else -1)
                number.append(-1 if inner else first + node[0])
                if not inner:
                    owner.append(c)
        self.root, self.dim, self.cut, self.left, self.right, self.number, self.owner = (np.array(x) for x in (self.root, dim, cut, left, right, number, owner))

    def __call__(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        at = self.root[cell]
        todo = np.flatnonzero(self.number[at] < 0)
        while len(todo):
            node = at[todo]
            at[todo] = np.where(x[todo, self.dim[node]] < self.cut[node], self.left[node], self.right[node])
            todo = todo[self.number[at[todo]] < 0]
        return self.number[at]


def _points(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of packed vectors (int32 each)."""
    column = column.cast(pa.binary())
    start, end = column.offset, column.offset + len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[start : end + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(np.int32).reshape(len(column), dims).astype(np.float64) if len(column) else np.zeros((0, dims))


def _packed(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x.astype(np.int32))
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _lists(taken: np.ndarray, names: np.ndarray) -> pa.Array:
    """The names of the columns marked in each row."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken.sum(1))).astype(np.int32)), pa.array(names[np.nonzero(taken)[1]].astype(np.int32)))


class Boxed:
    """References (ref_id, vec, cell where there is an index) in boxes, written once. A cell without rows is no cell."""

    def __init__(self, references: DataFrame, sizes: Sizes, boxes: int = MAX_BOXES) -> None:
        self.sizes, celled = sizes, "cell" in references.columns
        own = references.select("ref_id", "vec", (F.col("cell") if celled else F.lit(0)).cast("int").alias("cell"))
        self.n = own.count()
        if not self.n:
            return
        share = max(1, self.n // SAMPLE)
        some = own.filter(F.pmod(F.xxhash64("ref_id"), F.lit(share)) == 0) if share > 1 else own
        sample = some.limit(2 * SAMPLE).select("vec", "cell").toArrow().combine_chunks()
        top = own.agg(F.max("cell")).first()[0] + 1 if celled else 1
        points = matrix(sample.column("vec").combine_chunks()) if sample.num_rows else matrix(own.limit(1).select("vec").toArrow().column("vec").combine_chunks())
        cells = sample.column("cell").to_numpy() if sample.num_rows else np.zeros(1, int)
        self.dims = points.shape[1]
        leaves = max(1, min(-(-self.n // sizes.rows), max(boxes, top)) // top)
        forest = _Forest(points, cells, top, leaves)
        self.owner = forest.owner

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1))
                if len(x):
                    yield pa.record_batch([b.column(0), _packed(x), pa.array(forest(x, b.column(2).to_numpy()).astype(np.int32))], names=["ref_id", "x", "leaf"])

        self.rows = materialised(own.mapInArrow(dealt, "ref_id long, x binary, leaf int"), "boxes")
        self._measure()

    def _measure(self) -> None:
        """Numbers of references and bounds of the boxes."""
        dims, total = self.dims, len(self.owner)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, lo, hi = np.zeros(total, np.int64), np.full((total, dims), 2**31 - 1, np.int64), np.full((total, dims), -(2**31), np.int64)
            for b in batches:
                leaf, x = b.column(1).to_numpy(), _points(b.column(0), dims).astype(np.int64)
                order = np.argsort(leaf, kind="stable")
                own, at = np.unique(leaf[order], return_index=True)
                n[own] += np.diff(np.append(at, len(leaf)))
                lo[own] = np.minimum(lo[own], np.minimum.reduceat(x[order], at))
                hi[own] = np.maximum(hi[own], np.maximum.reduceat(x[order], at))
            used = np.flatnonzero(n)
            ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * dims)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(n[used]), *(pa.ListArray.from_arrays(ends, pa.array(v[used].ravel().astype(np.int32))) for v in (lo, hi))], names=["leaf", "n", "lo", "hi"])

        parts = self.rows.select("x", "leaf").mapInArrow(part, "leaf int, n long, lo array<int>, hi array<int>")
        lows, highs = ([f(F.col(c)[d]) for d in range(dims)] for f, c in ((F.min, "lo"), (F.max, "hi")))
        found = parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.array(*lows).alias("lo"), F.array(*highs).alias("hi")).toArrow().combine_chunks()
        at = found.column("leaf").to_numpy()
        self.count, self.lo, self.hi = np.zeros(total, np.int64), np.zeros((total, dims)), np.zeros((total, dims))
        self.count[at] = found.column("n").to_numpy()
        self.lo[at], self.hi[at] = (matrix(found.column(c).combine_chunks()) for c in ("lo", "hi"))

    def _asked(self, need: int, first: bool) -> Callable:
        """(id, vec, cells or null: all, kth or null) -> (id, x, kth, leaves): the boxes nearest to a query that hold `need`
        references, or the others (need 0: all) whose bound is at most kth."""
        every, owner = (self.lo, self.hi, self.count), self.owner
        cells = int(owner.max()) + 1

        def allowed(column: pa.Array) -> np.ndarray:
            out = np.zeros((len(column), cells), bool)
            for k, c in enumerate(column.to_pylist()):
                out[k, [x for x in c if x < cells] if c is not None else slice(None)] = True
            return out[:, owner]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside = batch.num_rows > 0 and not batch.column(2).null_count
                if inside:  # queries of the same cells in one step: only the boxes of its cells are looked at
                    batch = batch.take(pa.array(np.argsort([min(c, default=-1) for c in batch.column(2).to_pylist()], kind="stable")))
                for a in range(0, batch.num_rows, STEP_QUERIES):
                    b = batch.slice(a, STEP_QUERIES)
                    x = matrix(b.column(1))
                    mask = allowed(b.column(2)) if b.column(2).null_count < len(b) else None
                    used = np.flatnonzero(mask.any(0)) if inside and mask.any() else np.arange(len(owner))
                    lo, hi, count = (v[used] for v in every) if len(used) < len(owner) else every
                    d = np.zeros((len(x), len(used)))
                    for k in range(x.shape[1]):
                        gap = np.maximum(lo[:, k] - x[:, k : k + 1], x[:, k : k + 1] - hi[:, k])
                        np.maximum(gap, 0, out=gap)
                        d += gap * gap
                    d[:, count == 0] = np.inf
                    if mask is not None:
                        d[~mask[:, used]] = np.inf
                    begun = np.zeros(d.shape, bool)
                    if need:
                        near = d.argmin(1)
                        begun[np.arange(len(x)), near] = True
                        for k in np.flatnonzero(count[near] < need):
                            order = np.argsort(d[k], kind="stable")
                            begun[k, order[np.cumsum(count[order]) - count[order] < need]] = True
                        begun &= np.isfinite(d)
                    kth = b.column(3).fill_null(2**62).to_numpy()
                    taken = begun if first else ~begun & (d <= kth[:, None]) & np.isfinite(d)
                    yield pa.record_batch([b.column(0), _packed(x), pa.array(kth), _lists(taken, used)], names=["id", "x", "kth", "leaves"])

        return run

    def _met(self, asked: DataFrame, k: int, leave_self: bool) -> DataFrame:
        """(id, ref_id, dist): the k best of each query in each task, none above its kth."""
        spark, dims, sizes = asked.sparkSession, self.dims, self.sizes
        wanted = asked.select("id", "x", "kth", F.explode("leaves").alias("leaf"))
        asking = wanted.groupBy("leaf").agg(F.count("*").alias("n")).toArrow().to_pylist()
        if not asking:
            return spark.createDataFrame([], "id long, ref_id long, dist long")
        deal = [(r["leaf"], -(-int(self.count[r["leaf"]]) // (sizes.packs * sizes.rows)), -(-r["n"] // sizes.held)) for r in asking]
        plan = F.broadcast(spark.createDataFrame(deal, "leaf int, parts int, blocks int"))  # a row a box
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = ["leaf", "part", "block"]
        q = wanted.join(plan, "leaf").withColumn("block", own("id", "blocks"))
        q = q.withColumn("part", each("parts") if max(d[1] for d in deal) > 1 else F.lit(0)).select(*place, F.lit(1).alias("side"), "id", "x", "kth")
        r = self.rows.join(plan, "leaf").withColumn("part", own("ref_id", "parts"))
        r = r.withColumn("block", each("blocks") if max(d[2] for d in deal) > 1 else F.lit(0)).select(*place, F.lit(0).alias("side"), F.col("ref_id").alias("id"), "x", F.lit(0).cast("long").alias("kth"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for b in batches:
                if not b.num_rows:
                    continue
                keys = np.stack([b.column(c).to_numpy() for c in range(4)])
                row, x, kth = b.column(4).to_numpy(), _points(b.column(5), dims), b.column(6).to_numpy()
                cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
                out = []
                for lo, hi in zip(np.append(0, cut), np.append(cut, b.num_rows), strict=True):
                    if (here := tuple(keys[:3, lo])) != at:
                        at, held = here, []
                    if not keys[3, lo]:
                        held.append((row[lo:hi], x[lo:hi]))
                        continue
                    if len(held) > 1:
                        held = [tuple(np.concatenate(h) for h in zip(*held, strict=True))]
                    for a in range(lo, hi if held else lo, sizes.queries):
                        end = min(hi, a + sizes.queries)
                        best = Best(row[a:end], x[a:end], k, leave_self, kth[a:end])
                        refs, points = held[0]
                        for c in range(0, len(refs), sizes.rows):
                            best.add(refs[c : c + sizes.rows], points[c : c + sizes.rows])
                        out.append(best.rows())
                if out:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if sum(len(o) for o in out) else out[0]

        return r.unionByName(q).repartition(*place).sortWithinPartitions(*place, "side").mapInArrow(run, "id long, ref_id long, dist long")

    def search(self, queries: DataFrame, k: int, leave_self: bool = False, tighten: bool = False) -> DataFrame:
        """queries (id, vec; cells: those whose members count; kth: what bounds a search already) -> (id, ref_id, dist), in
        which the k nearest of every query are; queries with a kth may lack members beyond it.
        tighten: where a kth is loose, a first round looks for a nearer one."""
        none = lambda c, kind: F.col(c) if c in queries.columns else F.lit(None).cast(kind)
        own = queries.select("id", "vec", none("cells", "array<int>").alias("cells"), none("kth", "bigint").alias("kth"))
        if not self.n:
            return queries.sparkSession.createDataFrame([], "id long, ref_id long, dist long")
        need, schema = k + int(leave_self), "id long, x binary, kth long, leaves array<int>"
        if "kth" in queries.columns and not tighten:  # one round is enough where the k-th distance is bounded
            own = materialised(own, "bounded")
            bounded = self._met(materialised(own.filter("kth IS NOT NULL").mapInArrow(self._asked(0, False), schema), "asked"), k, leave_self)
            open_ = own.filter("kth IS NULL")
            return bounded.unionByName(self.search(open_.drop("kth"), k, leave_self)) if open_.take(1) else bounded
        begun = materialised(own.mapInArrow(self._asked(need, True), schema), "asked")
        early = materialised(ranked(self._met(begun, k, leave_self), k).drop("rank"), "early")
        limit = early.groupBy("id").agg(F.count("*").alias("found"), F.max("dist").alias("last")).filter(F.col("found") == k).select("id", "last")
        bounded = own.join(limit, "id", "left").select("id", "vec", "cells", F.least("kth", "last").alias("kth"))
        rest = materialised(bounded.mapInArrow(self._asked(need, False), schema), "asked")
        return early.unionByName(self._met(rest, k, leave_self))
