"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tarnspark.llm import common, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]


def slow_roots(texts):
    sets = slow_sets(texts)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(rng, words, n):
    """Words with n of them replaced, far enough apart that each costs five shingles."""
    out = list(words)
    for k in rng.sample(range(len(words) // 7), n):
        out[7 * k + 3] = f"edit{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def family_rows():
    """Families of copies on both sides of 0.8, chains whose ends differ, and one larger family."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = []
    for family in range(16):
        base = [rng.choice(words) for _ in range(200)]
        texts += [base, *(edited(rng, base, n) for n in (1, 2, 3, 4, 5, 7, 12))]
    chain = [rng.choice(words) for _ in range(200)]
    for _ in range(8):
        texts.append(chain)
        chain = edited(rng, chain, 3)
    base = [rng.choice(words) for _ in range(100)]
    texts += [edited(rng, base, rng.randint(0, 3)) for _ in range(60)]
    return [(1000 - k, " ".join(t), "en", "s", len(t)) for k, t in enumerate(texts)]


def test_copies_near_the_threshold_leave_one(spark, family_rows):
    rows = family_rows
    root = slow_roots([r[1] for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {min(r[0] for r, k in zip(rows, root, strict=True) if k == c) for c in set(root)}
    assert len(kept) < simhash.one_of_each(docs).count()  # four of 64 bits miss most copies near 0.8


@pytest.mark.parametrize("block", [512, 3])
def test_blocks_lose_no_pair(spark, family_rows, monkeypatch, block):
    plain = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda first, texts: plain(first, texts, block))
    root = slow_roots([r[1] for r in family_rows])
    assert near_copies.one_of_each(spark.createDataFrame(family_rows, SCHEMA)).count() == len(set(root))


def test_odd_rows(edge_rows, clashing_docs, empty_docs):
    root = slow_roots([r[1] for r in edge_rows])
    kept = near_copies.one_of_each(clashing_docs)
    assert kept.columns == clashing_docs.columns and kept.count() == len(set(root))
    assert not Counter((r["doc_id"], r["text"]) for r in kept.collect()) - Counter((r[0], r[1]) for r in edge_rows)
    assert near_copies.one_of_each(empty_docs).count() == 0


def test_simhash_links_are_candidates(spark, family_rows, monkeypatch):
    """The pipeline's stage goes through the SimHash grids: without MinHash, links of near fingerprints are still found."""
    grids, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: grids.append(1) or plain(fps, *a))
    docs = spark.createDataFrame(family_rows, SCHEMA).repartition(3)
    whole = corpus_pipeline.drop_near_duplicates(spark, docs, "").count()
    assert grids == [1]
    pairs = near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda first: pairs(first).limit(0))
    assert near_copies.one_of_each(docs).count() == whole  # MinHash alone completes them
    monkeypatch.undo()
    rows = next(near_copies._key_rows(iter([_batch(family_rows)])))
    fp = rows.column(4).to_pylist()
    keyed = spark.createDataFrame([(k, f) for k, f in zip(rows.column(2).to_pylist(), fp, strict=True)], "key long, fp long").distinct()
    found = near_copies.simhash_pairs(keyed).collect()
    of = dict(zip(rows.column(2).to_pylist(), fp, strict=True))
    assert len(found) > 10 and all(((of[r["a"]] ^ of[r["b"]]) & (2**64 - 1)).bit_count() <= 4 for r in found)


def _batch(rows):
    import pyarrow as pa

    return pa.record_batch([pa.array([r[0] for r in rows]), pa.array(range(len(rows))), pa.array([r[1] for r in rows])], names=["_d", "_tag", "text"])


def test_tasks_begin_and_end_by_giving_memory_back(monkeypatch):
    log = []
    monkeypatch.setattr(common, "trim", lambda: log.append("trim"))
    for x in common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2])):
        log.append(x)
    assert log == ["trim", 2, 4, "trim"]
