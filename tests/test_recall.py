"""Recall of the approximate index search against the exact one."""

import os

import pytest

from tarnspark.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_recall_of_the_index_search(spark):
    found = lambda name: {(r["q_id"], r["ref_id"]) for r in catalogue.QUERIES[name](spark, SF).collect()}
    exact = found("knn_exact_top5")
    assert len(found("ivf_recalled_topk") & exact) >= 0.9 * len(exact)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_counts_of_relaxed_searches(spark):
    """Verdicts of relaxed searches of transactions against the exact ones."""
    exact = {r["tx_id"]: r for r in catalogue.QUERIES["fraud_score"](spark, SF).collect()}
    for name in ("early_done", "approx_then_refine", "knn_epsilon", "visit_budget", "work_counters"):
        got = {r["tx_id"]: r["fraud_count"] for r in catalogue.QUERIES[name](spark, SF).collect()}
        assert set(got) == set(exact)
        same = sum(n == exact[t]["fraud_count"] for t, n in got.items())
        verdicts = sum((n < 3) == exact[t]["approved"] for t, n in got.items())
        assert same >= 0.9 * len(exact) and verdicts >= 0.95 * len(exact), (name, same, verdicts, len(exact))
