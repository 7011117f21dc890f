"""The box search of many queries: exact, with few boxes for a query, and with hot boxes split."""

import os

import numpy as np
import pytest

from tarnspark.operators import neighbours as N
from tarnspark.operators.boxes import Boxed
from tarnspark.operators.index import Exact
from tarnspark.operators.neighbours import nearest
from tarnspark.plans import catalogue

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(3)
CENTRES = RNG.integers(-9000, 9000, (40, 14))
POINTS = np.concatenate([CENTRES[RNG.integers(0, 40, 3000)] + RNG.integers(-40, 40, (3000, 14)), np.repeat(CENTRES[:1], 300, 0)])
#: Boxes of some 20 references; the copies of a centre fill one that cannot be split: 8 parts, and blocks of 50 queries.
SIZES = N.Sizes(16, 20, 2, 50)


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame([(k, p.tolist(), k % 3) for k, p in enumerate(POINTS)], "ref_id long, vec array<int>, cell int").repartition(4)


def slow(i, members=None):
    d = ((POINTS - POINTS[i]) ** 2).sum(1)
    order = [r for r in np.lexsort((np.arange(len(d)), d)) if r != i and (members is None or r % 3 in members)][:5]
    return [(int(r), int(d[r])) for r in order]


def best(df):
    out = {}
    for r in N.ranked(df, 5).orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["ref_id"], r["dist"]))
    return out


def test_boxes_are_exact_and_few(refs):
    """A query meets the boxes that may matter to it, not all references."""
    boxes = Boxed(refs.drop("cell"), SIZES)
    assert boxes.n == len(POINTS) and boxes.count.sum() == boxes.n and np.count_nonzero(boxes.count) > 100
    queries = refs.selectExpr("ref_id AS id", "vec")
    asked = queries.selectExpr("id", "vec", "CAST(NULL AS array<int>) AS cells", "CAST(NULL AS bigint) AS kth").mapInArrow(boxes._asked(6, True), "id long, x binary, kth long, leaves array<int>")
    met = sum(int(boxes.count[r["leaves"]].sum()) for r in asked.collect())
    assert met < 0.2 * len(POINTS) ** 2
    found = best(boxes.search(queries, 5, True))
    assert all(found[i] == slow(i) for i in range(len(POINTS)))


def test_members_of_some_cells(refs):
    """Only members of a query's cells count; a cell that no reference has adds none, and a known k-th distance loses none."""
    boxes = Boxed(refs, SIZES)
    assert set(boxes.owner.tolist()) == {0, 1, 2}
    queries = refs.filter("ref_id % 7 = 0").selectExpr("ref_id AS id", "vec", "IF(ref_id % 2 = 0, array(0, 2, 99), array(1)) AS cells")
    want = {i: slow(i, (0, 2) if i % 2 == 0 else (1,)) for i in range(0, len(POINTS), 7)}
    assert best(boxes.search(queries, 5, True)) == want
    kth = queries.sparkSession.createDataFrame([(i, w[-1][1]) for i, w in want.items()], "id long, kth long")
    assert best(boxes.search(queries.join(kth, "id"), 5, True)) == want


def test_more_queries_than_a_block_go_through_boxes(refs, monkeypatch):
    """Queries and references do not meet all with all: no row of the search holds a pack of references."""
    used = []
    plain = Boxed.search
    monkeypatch.setattr(Boxed, "search", lambda self, *a: used.append(self.n) or plain(self, *a))
    queries = refs.filter("ref_id % 5 = 0").selectExpr("ref_id AS id", "vec")
    found = best(nearest(queries, refs.drop("cell"), 5, True, block=100))
    assert used == [len(POINTS)] and all(found[i] == slow(i) for i in range(0, len(POINTS), 5))


def test_an_exact_index_builds_its_boxes_once(refs, monkeypatch):
    """Batches of a stream search the same boxes."""
    built, plain = [], N.in_boxes
    monkeypatch.setattr(N.nearest, "__defaults__", (*N.nearest.__defaults__[:2], 100, None))
    monkeypatch.setattr("tarnspark.operators.index.in_boxes", lambda r: built.append(1) or plain(r))
    index = Exact(refs.selectExpr("ref_id", "vec", "cell = 0 AS is_fraud"))
    queries = refs.filter("ref_id % 20 = 0").selectExpr("ref_id AS id", "vec")
    counts = [{r["id"]: r["fraud_count"] for r in index.counts(queries, 5, True).collect()} for _ in range(2)]
    assert built == [1] and counts[0] == counts[1] == {i: sum(r % 3 == 0 for r, _ in slow(i)) for i in range(0, len(POINTS), 20)}


def test_bounded_queries_take_one_round(refs, monkeypatch):
    """A known k-th distance spares the round that looks for one; queries without one still get theirs."""
    boxes, rounds, plain = Boxed(refs.drop("cell"), SIZES), [], Boxed._met
    monkeypatch.setattr(Boxed, "_met", lambda self, *a: rounds.append(1) or plain(self, *a))
    queries = refs.filter("ref_id % 50 = 0").selectExpr("ref_id AS id", "vec")
    want = {i: slow(i) for i in range(0, len(POINTS), 50)}
    known = queries.sparkSession.createDataFrame([(i, w[-1][1]) for i, w in want.items()], "id long, kth long")
    assert best(boxes.search(queries.join(known, "id"), 5, True)) == want and len(rounds) == 1
    loose = known.selectExpr("id", "kth + 1000000000 AS kth")
    assert best(boxes.search(queries.join(loose, "id"), 5, True, tighten=True)) == want and len(rounds) == 3
    rounds[:] = [1]
    some = known.selectExpr("id", "IF(id % 100 = 0, NULL, kth) AS kth")
    assert best(boxes.search(queries.join(some, "id"), 5, True)) == want and len(rounds) == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["approx_then_refine", "work_counters", "knn_epsilon"])
def test_searches_of_a_query_share_their_boxes(spark, monkeypatch, name):
    """The cells' boxes answer the exact search too, and few rounds are made: two, one bounded by them, one that settles."""
    built, rounds, make, plain = [], [], Boxed.__init__, Boxed._met
    monkeypatch.setattr(Boxed, "__init__", lambda self, *a: built.append(1) or make(self, *a))
    monkeypatch.setattr(Boxed, "_met", lambda self, *a: rounds.append(1) or plain(self, *a))
    monkeypatch.setattr(N.nearest, "__defaults__", (*N.nearest.__defaults__[:2], 1, None))
    found = catalogue.QUERIES[name](spark, SF)
    assert found.count() == 147 and len(built) == 1 and len(rounds) <= 4


def test_queries_are_written_once(spark, monkeypatch):
    """Steps of a search read the queries, not all references, to find them."""
    written, plain = [], catalogue.materialised
    monkeypatch.setattr(catalogue, "materialised", lambda df, name: written.append(name) or plain(df, name))
    queries, refs = catalogue._transactions(spark, "/root/testdata/sf0.001")
    assert written == ["features", "queries"] and 0 < queries.count() == refs.filter("ref_id % 100 = 0").count()
    assert not set(queries.inputFiles()) & set(refs.inputFiles())
