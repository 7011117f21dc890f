"""Searches against brute force, with forced ties, few references, large query sets and skewed cells."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import cells as C
from tarnspark.operators import neighbours as N
from tarnspark.operators.decisions import confusion, decided, fail_safe, response, votes
from tarnspark.operators.index import Constant, Exact, Probed, Pruned
from tarnspark.operators.neighbours import constant, listed, nearest
from tarnspark.sources.cell_store import build_index, read_index, read_stats, write_index

RNG = np.random.default_rng(8)
POINTS = np.concatenate([RNG.integers(-60, 60, (400, 14)), np.zeros((60, 14), int), RNG.integers(0, 2, (60, 14)) * 50])
QUERIES = np.concatenate([RNG.integers(-60, 60, (25, 14)), np.zeros((1, 14), int), np.full((1, 14), 9000)])


@pytest.fixture(scope="module")
def tables(spark):
    refs = spark.createDataFrame([(k, p.tolist(), k % 3 == 0) for k, p in enumerate(POINTS)], "ref_id long, vec array<int>, is_fraud boolean").repartition(5)
    queries = spark.createDataFrame([(1000 + k, q.tolist()) for k, q in enumerate(QUERIES)], "id long, vec array<int>")
    return queries, refs


def slow(k, points=POINTS):
    out = []
    for n, q in enumerate(QUERIES):
        d = ((points - q) ** 2).sum(1)
        out += [(1000 + n, r + 1, int(i), int(d[i])) for r, i in enumerate(np.lexsort((np.arange(len(d)), d))[:k])]
    return out


def rows(df):
    return sorted((r["id"], r["rank"], r["ref_id"], r["dist"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 70])
def test_exact(tables, k):
    assert rows(nearest(*tables, k)) == slow(k)


def test_blocks_of_queries_and_few_references(spark, tables):
    queries, refs = tables
    assert rows(nearest(queries, refs, 5, block=4)) == slow(5)
    assert rows(nearest(queries, refs.filter("ref_id < 3"), 5)) == slow(5, POINTS[:3])
    none = nearest(queries, refs.filter("ref_id < 0"), 5)
    counts = decided(votes(none, queries))
    assert counts.count() == len(QUERIES) and {(r["fraud_count"], r["approved"]) for r in counts.collect()} == {(0, True)}
    assert nearest(queries.limit(0), refs, 5).count() == 0
    with pytest.raises(ValueError):
        nearest(queries, refs, 0)


def test_self_is_left_out(tables):
    _, refs = tables
    q = refs.filter("ref_id % 50 = 0").select(F.col("ref_id").alias("id"), "vec")
    assert nearest(q, refs, 5, leave_self=True).filter("id = ref_id").count() == 0


def test_more_queries_than_a_block_and_few_held(spark, tables, monkeypatch):
    """The grid of packs: many small packs, and tasks that pass on what they hold early."""
    queries, refs = tables
    for name, n in (("PACK_QUERIES", 3), ("PACK_ROWS", 40), ("HELD_QUERIES", 8)):
        monkeypatch.setattr(N, name, n)
    assert rows(nearest(queries, refs, 5, block=4)) == slow(5)
    q = refs.select(F.col("ref_id").alias("id"), "vec")
    assert rows(nearest(q, refs, 3, True, block=10)) == rows(nearest(q, refs, 3, True))


def indexes(refs):
    boxes = C.boxed(refs, C.fit_boxes(refs, 24))
    centroids = C.seed_centroids(refs, 12)
    ivf = C.assigned(refs, centroids)
    return (boxes, C.Boxes(C.boxes(boxes))), (ivf, C.Balls(centroids, C.cell_stats(ivf))), centroids


@pytest.mark.parametrize("small", [False, True])
def test_pruned_searches_equal_exact(tables, monkeypatch, small):
    queries, refs = tables
    if small:  # several packs and salts in a cell
        for module, name, n in ((C, "PACK_QUERIES", 2), (C, "PACK_ROWS", 7), (C, "SALT_PACKS", 2)):
            monkeypatch.setattr(module, name, n)
    want = slow(5)
    (boxes, bounds), (ivf, balls), centroids = indexes(refs)
    assert boxes.select("cell").distinct().count() > 8
    for cells, b in ((boxes, bounds), (ivf, balls)):
        found, work = C.pruned(queries, cells, b, 5)
        assert rows(found) == want and "is_fraud" in found.columns
        done = work.collect()
        assert len(done) == len(QUERIES) and not any(r["stopped"] for r in done)
        assert all(5 <= r["visits"] <= len(POINTS) and r["checks"] == len(b.cell) for r in done)
    assert rows(C.probed(queries, ivf, centroids, 12, 5)) == want


def slow_pruned(k, cells, bounds, epsilon, budget):
    """(id -> neighbours, visits, stopped) of a relaxed search, cell by cell."""
    out = {}
    for n, q in enumerate(QUERIES):
        d = ((POINTS - q) ** 2).sum(1)
        order = sorted(zip(bounds(q[None].astype(float))[0], bounds.cell, strict=True))
        best = lambda members: [int(members[i]) for i in np.lexsort((members, d[members]))[:k]]
        held, early, ahead = 0, [], {}
        for b, c in order:
            ahead[c] = held
            if held < k:
                early.append(c)
            held += len(cells[c])
        members = np.concatenate([cells[c] for c in early])
        kth = d[best(members)[-1]] if len(members) >= k else np.inf
        matter = [(b, c) for b, c in order if c not in early and b <= kth]
        late = [c for b, c in matter if b <= kth * (1 - epsilon) and ahead[c] < budget]
        members = np.concatenate([cells[c] for c in early + late])
        out[1000 + n] = (best(members), len(members), len(late) < len(matter))
    return out


@pytest.mark.parametrize("epsilon,budget", [(0.0, None), (0.3, None), (0.0, 60), (0.6, 100)])
def test_relaxed_searches(tables, epsilon, budget):
    queries, refs = tables
    for cells, bounds in indexes(refs)[:2]:
        members = {}
        for r in cells.select("cell", "ref_id").collect():
            members.setdefault(r["cell"], []).append(r["ref_id"])
        want = slow_pruned(5, {c: np.array(sorted(m)) for c, m in members.items()}, bounds, epsilon, np.inf if budget is None else budget)
        found, work = C.pruned(queries, cells, bounds, 5, epsilon=epsilon, budget=budget)
        got = {}
        for i, _, ref, _ in rows(found):
            got.setdefault(i, []).append(ref)
        done = {r["id"]: r for r in work.collect()}
        assert {i: (got[i], done[i]["visits"], done[i]["stopped"]) for i in done} == want
        assert any(w[2] for w in want.values()) == bool(epsilon or budget)
    with pytest.raises(ValueError):
        C.pruned(queries, cells, bounds, epsilon=1.0)


def test_approximate_searches(tables):
    queries, refs = tables
    centroids = C.kmeans_centroids(refs, 8, sample=200)
    ivf = C.assigned(refs, centroids)
    want = {r[:3] for r in slow(5)}
    recall = [len({r[:3] for r in rows(C.probed(queries, ivf, centroids, n, 5))} & want) / len(want) for n in (1, 4, len(centroids))]
    assert recall[0] <= recall[1] <= recall[2] == 1.0
    near = sorted({r[3] for r in rows(C.probed(queries, ivf, centroids, 1, 5)) if r[1] == 5})
    for enough in (-1, near[len(near) // 2], 10**9):
        found, state = C.early_done(queries, ivf, centroids, len(centroids), enough, 5)
        stopped = {r["id"] for r in state.collect() if r["stopped"]}
        one = rows(C.probed(queries, ivf, centroids, 1, 5))
        assert stopped == {r[0] for r in one if r[1] == 5 and r[3] <= enough}
        assert rows(found) == sorted([r for r in one if r[0] in stopped] + [r for r in slow(5) if r[0] not in stopped])
    with pytest.raises(ValueError):
        C.probes(queries, centroids, len(centroids) + 1)
    with pytest.raises(ValueError):
        C.seed_centroids(refs, 0)


def test_lloyd_steps(tables):
    _, refs = tables
    c = C.seed_centroids(refs, 6)
    moved = C.lloyd(refs, c, 2)
    for _ in range(2):
        cell = ((POINTS[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([np.floor(POINTS[cell == k].sum(0) / (cell == k).sum() + 0.5) if (cell == k).any() else c[k] for k in range(6)])
    assert np.array_equal(moved, c)


def test_indexes_are_interchangeable(tables):
    queries, refs = tables
    exact = {r["id"]: r["fraud_count"] for r in Exact(refs).counts(queries).collect()}
    (boxes, bounds), (ivf, balls), centroids = indexes(refs)
    for index in (Pruned(boxes, bounds), Pruned(ivf, balls), Probed(ivf, centroids, 12)):
        assert {r["id"]: r["fraud_count"] for r in index.counts(queries).collect()} == exact and index.size() == len(POINTS)
    loose = {r["id"]: r["fraud_count"] for r in Pruned(boxes, bounds, budget=30, settle=False).counts(queries).collect()}
    settled = {r["id"]: r["fraud_count"] for r in Pruned(boxes, bounds, budget=30).counts(queries).collect()}
    stopped = {r["id"] for r in C.pruned(queries, boxes, bounds, budget=30)[1].collect() if r["stopped"]}
    assert settled == {i: exact[i] if i in stopped and n in (2, 3) else n for i, n in loose.items()}
    assert {r["fraud_count"] for r in Constant().counts(queries).collect()} == {2} and Constant().size() == 0


def test_refinement_settles_undecided_counts(tables):
    queries, refs = tables
    centroids = C.seed_centroids(refs, 12)
    approx = votes(C.probed(queries, C.assigned(refs, centroids), centroids, 1), queries)
    exact = {r["id"]: r["fraud_count"] for r in votes(nearest(queries, refs, 5), queries).collect()}
    first = {r["id"]: r["fraud_count"] for r in approx.collect()}
    for r in C.refined(approx, queries, refs).collect():
        assert r["fraud_count"] == (exact if first[r["id"]] in (2, 3) else first)[r["id"]] and r["refined"] == (first[r["id"]] in (2, 3))


def test_cell_reports(tables):
    _, refs = tables
    ivf = C.assigned(refs, C.seed_centroids(refs, 12))
    sizes = sorted([r["n"] for r in C.cell_stats(ivf).collect()] + [0] * (12 - C.cell_stats(ivf).count()))
    r = C.build_report(ivf, 12).first()
    assert (r["empty_cells"], r["min_size"], r["p50_size"], r["p99_size"], r["max_size"]) == (sizes.count(0), sizes[0], sizes[6], sizes[11], sizes[-1])
    assert r["mean_size"] == len(POINTS) / 12
    offsets = C.cell_offsets(ivf, 12).orderBy("cell").collect()
    assert [o["start"] for o in offsets] == [0, *np.cumsum([o["n"] for o in offsets])[:-1].tolist()] and sum(o["n"] for o in offsets) == len(POINTS)
    sums = C.centroid_sums(ivf).filter("dim = 0").agg(F.sum("total"), F.sum("n")).first()
    assert tuple(sums) == (int(POINTS[:, 0].sum()), len(POINTS))


def test_index_store(spark, tables, tmp_path):
    _, refs = tables
    centroids = C.seed_centroids(refs, 6)
    ivf = C.assigned(refs, centroids)
    write_index(ivf, str(tmp_path / "index"), centroids)
    back, c = read_index(spark, str(tmp_path / "index"), 14)
    assert np.array_equal(c, centroids) and back.count() == len(POINTS)
    assert "PartitionFilters: [isnotnull(cell" in back.filter("cell = 2").select("ref_id")._jdf.queryExecution().toString()
    assert sorted(map(tuple, read_stats(spark, str(tmp_path / "index")).collect())) == sorted(map(tuple, C.cell_stats(ivf).collect()))
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "index"), 64)
    source = tmp_path / "references.json"
    source.write_text(json.dumps([{"vector": (p / 10000).tolist(), "label": "fraud"} for p in POINTS]))
    build_index(spark, str(source), str(tmp_path / "built"), 4, n=300)
    built, c = read_index(spark, str(tmp_path / "built"), 14)
    assert built.count() == 300 and len(c) <= 4 and read_stats(spark, str(tmp_path / "built")).agg(F.sum("n")).first()[0] == 300


def test_lists_votes_and_decisions(spark, tables):
    queries, refs = tables
    one = listed(nearest(queries, refs, 3)).filter("id = 1000").first()
    assert one["ref_ids"] == [r[2] for r in slow(3)[:3]] and one["kth"] == slow(3)[2][3]
    d = decided(spark.createDataFrame([(k, k) for k in range(6)], "id long, fraud_count int"))
    assert [r["b"] for r in d.select(response().alias("b")).collect()] == [f'{{"approved":{str(k < 3).lower()},"fraud_score":{k / 5}}}' for k in range(6)]
    assert {r["fraud_count"] for r in constant(queries).collect()} == {2}
    safe = spark.createDataFrame([(True, 1), (True, None), (False, 0)], "ok boolean, n int").select(fail_safe(F.col("n"), F.col("ok")).alias("x")).collect()
    assert [r["x"] for r in safe] == [1, 3, 3]
    c = confusion(d.withColumn("is_fraud", F.col("id") % 2 == 0)).first()
    assert tuple(c) == (1, 2, 2, 1, 2 * 1 + 2 * 3)
