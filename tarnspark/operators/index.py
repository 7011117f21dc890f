"""Interchangeable search indexes: whatever answers a table of queries with their neighbours and counts of positive labels
can score requests, in batches and streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.operators import cells as C
from tarnspark.operators.decisions import votes
from tarnspark.operators.boxes import Boxed
from tarnspark.operators.neighbours import constant, in_boxes, nearest
from tarnspark.schema import NEIGHBOURS


class Index(Protocol):
    """counts: (id, fraud_count) of every query (id, vec), in which only k nearest references count. size: references."""

    def counts(self, queries: DataFrame, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame: ...

    def size(self) -> int: ...


@dataclass
class Exact:
    """A full scan of the references; more queries than a block go through boxes, built once for all batches."""

    references: DataFrame
    _boxes: Boxed | None = field(default=None, init=False, repr=False, compare=False)

    def counts(self, queries: DataFrame, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame:
        return votes(nearest(queries, self.references, k, leave_self, boxes=self._in_boxes), queries)

    def _in_boxes(self) -> Boxed:
        self._boxes = self._boxes or in_boxes(self.references)
        return self._boxes

    def size(self) -> int:
        return self.references.count()


@dataclass
class Pruned:
    """Cells and bounds of their distances. Relaxed (epsilon, budget), undecided counts of searches that stopped early are
    settled by an exact scan if `settle` is set."""

    cells: DataFrame
    bounds: Callable
    epsilon: float = 0.0
    budget: int | None = None
    settle: bool = True

    def counts(self, queries: DataFrame, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame:
        found, work = C.pruned(queries, self.cells, self.bounds, k, leave_self, self.epsilon, self.budget)
        counts = votes(found, queries)
        if not self.settle or (not self.epsilon and self.budget is None):
            return counts
        stopped = counts.join(work.select("id", "stopped"), "id")
        return C.refined(C.materialised(stopped, "approximate"), queries, self.cells.drop("cell", "cell_dist"), k, leave_self=leave_self).drop("refined")

    def size(self) -> int:
        return self.cells.count()


@dataclass
class Probed:
    """An inverted file of which the n nearest cells are searched."""

    cells: DataFrame
    centroids: np.ndarray
    n: int

    def counts(self, queries: DataFrame, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame:
        return votes(C.probed(queries, self.cells, self.centroids, self.n, k, leave_self), queries)

    def size(self) -> int:
        return self.cells.count()


@dataclass
class Constant:
    """A stand-in without references, for tests of what lies around the search."""

    count: int = 2

    def counts(self, queries: DataFrame, k: int = NEIGHBOURS, leave_self: bool = False) -> DataFrame:
        return constant(queries, self.count).select("id", F.col("fraud_count").cast("int").alias("fraud_count"))

    def size(self) -> int:
        return 0
