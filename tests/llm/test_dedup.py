"""SimHash components and repeated passages against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tarnspark.llm import components, simhash, suffix_dedup


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Least index reachable within four bits, by flooding."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 4 and root[b] != root[a]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprints(edge_rows):
    for r in edge_rows:
        assert simhash.fingerprint((r[1] or "").encode()) == slow_fingerprint(r[1])


def test_near_duplicates_and_one_of_each(spark, edge_rows, edge_docs, clashing_docs, empty_docs):
    fps = [slow_fingerprint(r[1]) for r in edge_rows]
    root = slow_components(fps)
    least = {}
    for r, k in zip(edge_rows, root, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], fp, least.get(k)) for r, fp, k in zip(edge_rows, fps, root, strict=True))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(clashing_docs).collect())
    assert got == want
    kept = simhash.one_of_each(clashing_docs)
    assert kept.columns == clashing_docs.columns
    assert kept.count() == len(set(root))
    assert simhash.near_duplicates(empty_docs).count() == 0 and simhash.one_of_each(empty_docs).count() == 0


@pytest.mark.parametrize("block,groups", [(2048, None), (3, 6), (2048, 7), (20, 8), (2048, 10)])
def test_links_of_random_and_crowded_fingerprints(spark, block, groups):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base for _ in range(4)]
    crowd = [sum(1 << int(k) for k in rng.choice(64, 2, replace=False)) for _ in range(80)]
    fps = sorted({*map(int, base), *near, *crowd, 0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block, groups).collect()
    at = {f: k for k, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in links:
        assert (fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() <= 4
        a, b = find(at[r["a"]]), find(at[r["b"]])
        root[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(fps))] == slow_components(fps)


def test_grids_cover_all_segments():
    for g in range(6, 11):
        masks = simhash.Grids(g).masks
        assert sum(masks) == (1 << 64) - 1 and len(masks) == g
    sizes = [10, 1 << 19, 1 << 22, 1 << 26, 1 << 29, 1 << 33, 1 << 40]
    assert [simhash.groups_for(n) for n in sizes] == sorted(simhash.groups_for(n) for n in sizes) and simhash.groups_for(10) == 6


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    d = simhash.manhattan(simhash._embedded(a), simhash._embedded(b))
    assert (d <= np.bitwise_count(a ^ b)).all() and d.max() > 4


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}


def slow_repeats(texts):
    """Per text: bytes, removed, runs, hash of what is left."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                hit[k : k + 400] = True
        runs = int((np.diff(np.append(0, hit.astype(int))) == 1).sum())
        out.append((len(b), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [16384, 2])
def test_repeats(edge_rows, clashing_docs, block):
    want = Counter((r[0], *x) for r, x in zip(edge_rows, slow_repeats([r[1] for r in edge_rows]), strict=True))
    rows = suffix_dedup.with_spans(clashing_docs, block=block).selectExpr("doc_id", "coalesce(text, '') AS text", "spans")
    got = Counter(map(tuple, rows.mapInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()))
    assert got == want
    assert sum(k[2] * n for k, n in want.items()) > 5000


def slow_word_repeats(texts, depth=50):
    """Texts without the words that a repeated run of depth words covers, nor the white space behind them."""
    words = [[(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    seen = Counter(tuple(w for _, w in ws[k : k + depth]) for ws in words for k in range(len(ws) - depth + 1))
    out = []
    for t, ws in zip(texts, words, strict=True):
        hit = np.zeros(len(ws), bool)
        for k in range(len(ws) - depth + 1):
            if seen[tuple(w for _, w in ws[k : k + depth])] > 1:
                hit[k : k + depth] = True
        edges = [p for p, _ in ws] + [len(t or "")]
        kept = (t or "")[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(ws)) if not hit[k])
        out.append(kept if hit.any() else t)
    return out


@pytest.fixture(scope="module")
def passages():
    """Texts that share passages of 49 to 80 short words, under 400 bytes, with other white space between the words."""
    rng = np.random.default_rng(11)

    def words(n):
        return ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(n)]

    shared = [words(n) for n in (49, 50, 51, 60, 80)]
    texts = []
    for k in range(40):
        body, n = words(int(rng.integers(0, 200))), int(rng.integers(0, 200))
        body[n:n] = shared[k % 5] if k % 4 else []
        texts.append("  \n".join(body) if k % 7 == 0 else " ".join(body))
    return [*texts, " ".join(shared[2]), " ".join(shared[2] * 2), None, "", " \n ", texts[1], "tick " * 120]


@pytest.mark.parametrize("block", [16384, 2])
def test_word_passages(spark, passages, block):
    want = slow_word_repeats(passages)
    assert max(len(" ".join(p.split()[-80:])) for p in passages if p) < 400
    assert sum(w != t for w, t in zip(want, passages, strict=True)) > 20
    docs = spark.createDataFrame([(k if k % 3 else None, t, k) for k, t in enumerate(passages)], "doc_id long, text string, row int").repartition(3)
    rows = suffix_dedup.with_spans(docs, suffix_dedup.WORDS, block)
    spans = {(r["doc_id"], r["text"]): r["spans"] for r in rows.collect()}
    for k, (t, w) in enumerate(zip(passages, want, strict=True)):
        assert (spans[k if k % 3 else None, t] is not None) == (w != t)
    got = {r["row"]: r["text"] for r in suffix_dedup.without_repeats(docs, window=suffix_dedup.WORDS).collect()}
    assert got == dict(enumerate(want))


def test_rows_without_ids_are_told_apart(spark):
    """Equal and missing ids: only texts that repeat lose bytes."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefghij klm"), 640)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for t in texts for i in (None, 7)][:-1], "doc_id long, text string")
    left = Counter(r["spans"] is None for r in suffix_dedup.with_spans(docs).collect())
    assert left == {False: 118, True: 1}


def test_misleading_hashes_are_compared(monkeypatch):
    """Where all windows have one hash, the units decide."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    w = suffix_dedup.Window(8, 4)
    bodies = [bytes(rng.integers(97, 99, 12, dtype=np.uint8)) for _ in range(40)]
    m = lambda: suffix_dedup._Members(w, np.array([1] * 20 + [2] * 20), np.full(40, 4), pa.array(bodies))
    want = m().compared()
    plain = m().repeated()
    assert (want[1] >= 0).any() and (want[1] < 0).any()
    assert all((a == b).all() for a, b in zip(want, plain, strict=True))
    monkeypatch.setattr(suffix_dedup, "_BYTE", np.zeros(256, np.uint64))
    assert all((a == b).all() for a, b in zip(want, m().repeated(), strict=True))


@pytest.mark.parametrize("w", [suffix_dedup.BYTES, suffix_dedup.WORDS])
def test_long_texts_in_parts(monkeypatch, w):
    text = np.random.default_rng(6).integers(97, 110, 30_000, dtype=np.uint8)
    text[::9] = 32
    units, own = w.units(text, np.array([0, len(text)]))
    at, key, first, last = suffix_dedup.anchors(w, units, own)
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    at2, key2, first2, last2 = suffix_dedup.anchors(w, units, own)
    whole = {s: (a, k) for a, k, f, e in zip(at, key, first, last, strict=True) for s in range(f, e + 1)}
    parts = [(s, (a, k)) for a, k, f, e in zip(at2, key2, first2, last2, strict=True) for s in range(f, e + 1)]
    assert len(parts) == len(whole) and dict(parts) == whole and len(at2) > len(at)


def test_texts_without_repeats(edge_rows, clashing_docs, empty_docs):
    left = suffix_dedup.without_repeats(clashing_docs)
    assert left.columns == clashing_docs.columns and left.count() == len(edge_rows)
    clean = suffix_dedup.without_repeats(clashing_docs, drop_emptied=True)
    assert clean.count() < len(edge_rows)
    assert clean.filter("doc_id = 108").count() == 0  # one letter, repeated: nothing is left
    assert clean.filter("doc_id = 101").count() == 1  # empty before
    assert suffix_dedup.without_repeats(empty_docs).count() == 0
