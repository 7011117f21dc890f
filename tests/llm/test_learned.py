"""Toxicity, quality rules and the byte network: exactness of searches and bounds, held-out accuracy, degenerate inputs."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tarnspark.llm import folds, known_terms, quality_net, quality_rules, toxicity

BAD = ["idiot", "scumbag", "worthless"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Labelled prose: toxic documents hold bad words, low-quality ones are set in capitals with marks."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(60, 140))]
        toxic, low = k % 5 == 0, k % 3 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((k, " ".join(text).upper().replace(" ", "!! ") if low else " ".join(text), ["en", "de"][k % 2], int(not low), int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    return docs, spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality int, toxic int"), rows


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_folds(spark, corpus):
    docs, labels, rows = corpus
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", folds.held_out().alias("h")).collect()}
    assert got == {r[0]: is_held_out(r[0]) for r in rows}
    s = folds.sample(docs, labels, "toxic", 50, 1 << 20, 1 << 20).collect()
    assert Counter(r["y"] for r in s) == {0: 50, 1: 50} and not any(is_held_out(r["doc_id"]) for r in s)


def test_samples_are_bounded_and_repeatable(spark):
    """Many rows of one doc_id, labels that disagree, and long texts do not widen the sample."""
    rows = [(1, f"text {k}") for k in range(3000)] + [(2, "x" * 5000), (4, "y" * 400), (7, "z" * 400), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, y) for k in (1, 2, 4, 7, 8) for y in (0, 1)] + [(1, 0)] * 3, "doc_id long, toxic int")
    got = {(r["doc_id"], r["y"], r["text"]) for r in folds.sample(docs, labels, "toxic", 10, 1000, 1 << 20).collect()}
    want = {(1, 1, "text 0"), (4, 1, "y" * 400), (7, 1, "z" * 400), (8, 1, "")}
    assert got == {w for w in want if not is_held_out(w[0])} and len(got) >= 3
    assert sum(len(r["text"]) for r in folds.sample(docs, labels, "toxic", 10, 1000, 410).collect()) <= 410
    assert folds.label_counts(labels, "toxic") == (0, sum(not is_held_out(k) for k in (1, 2, 4, 7, 8)))


@pytest.fixture(scope="module")
def index(corpus):
    return toxicity.fit(corpus[0], corpus[1])


def slow_vectors(rows, labelled):
    """TF-IDF vectors with phi, from the texts alone: of any text, and of the examples."""
    split = {r[0]: Counter(re.findall(r"[^\W_]+", (r[1] or "").lower())) for r in rows}
    examples = {d: y for d, y in labelled.items() if not is_held_out(d)}
    df = Counter(t for c in split.values() for t in c)
    n = {y: sum(v == y for v in examples.values()) for y in (0, 1)}
    held = {y: Counter(t for d, v in examples.items() if v == y for t in split[d]) for y in (0, 1)}

    def phi(t):
        a, b = held[1][t], held[0][t]
        spread = (a + b) * (n[0] + n[1] - a - b) * n[0] * n[1]
        return abs(a * (n[0] - b) - b * (n[1] - a)) / math.sqrt(spread) if spread else 0.0

    factor = {t: math.log((1 + len(rows)) / (1 + df[t])) * phi(t) for t in held[0] | held[1]}

    def vector(counts):
        w = {t: (1 + math.log(c)) * factor[t] for t, c in counts.items() if factor.get(t)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    return {d: vector(c) for d, c in split.items()}, examples


def test_nearest_examples_are_exact(corpus, index):
    """Against cosines of vectors that are made from the texts, with every example and every term."""
    vectors, examples = slow_vectors(corpus[2], {r[0]: r[4] for r in corpus[2]})
    assert set(index.example.tolist()) == set(examples)
    some = corpus[2][::3]
    assert 0 < len(index.doc) < len(index.own)  # frequent terms and others
    for r, (found, sim) in zip(some, index.nearest([index.query(r[1]) for r in some], 7), strict=True):
        own = vectors[r[0]]
        full = {d: sum(x * vectors[d].get(t, 0.0) for t, x in own.items()) for d in examples}
        best = sorted(full.values(), reverse=True)[:7]
        assert np.allclose(sim, best) and np.allclose([full[int(index.example[f])] for f in found], best)


@pytest.mark.parametrize("few", [0, 2])
def test_nearest_examples_by_short_and_bounded_lists(corpus, monkeypatch, few):
    """With few frequent terms, lists that are bounded block by block (picked or read whole) and lists read whole; texts beyond
    Latin-1, whose words lie in other places, among them."""
    monkeypatch.setattr(toxicity, "HEAD", 100)
    monkeypatch.setattr(toxicity, "BOUNDED", 700)
    monkeypatch.setattr(toxicity, "FEW", few)
    index = toxicity.fit(corpus[0], corpus[1])
    assert len(index.head) == 100 and len(index.most) == 600 < len(index.terms) - 100
    vectors, examples = slow_vectors(corpus[2], {r[0]: r[4] for r in corpus[2]})
    some = corpus[2][::9]
    for r, (found, sim) in zip(some, index.nearest(index.queries(["\u0416_" + r[1] + "\u2014" for r in some]), 7), strict=True):
        own = vectors[r[0]]
        full = {d: sum(x * vectors[d].get(t, 0.0) for t, x in own.items()) for d in examples}
        best = sorted(full.values(), reverse=True)[:7]
        assert np.allclose(sim, best) and np.allclose([full[int(index.example[f])] for f in found], best)


def test_postings_that_cannot_matter_are_not_read(monkeypatch):
    """Two subjects with words of their own and some in common: of the common words' lists, a text reads few blocks."""
    rng = np.random.default_rng(5)
    n, own, common = 4096, 40, 200
    owner = np.repeat(np.arange(n), 11)
    term = np.concatenate([np.append((k % 2) * own + rng.choice(own, 8, False), 2 * own + rng.choice(common, 3, False)) for k in range(n)])
    words = [f"w{t:03}" for t in range(2 * own + common)]
    monkeypatch.setattr(toxicity, "HEAD", 2 * own)
    terms = toxicity.Terms.of(words)
    index = toxicity._index(terms, np.full(len(words), 9.0), n, np.arange(n), np.arange(n) % 2, owner, term, np.ones(len(term)), np.array([n, n]))
    queries = index.queries([" ".join(words[t] for t in term[owner == k]) for k in range(64)])
    read, sums = [], toxicity.Index._sums
    monkeypatch.setattr(toxicity.Index, "_sums", lambda self, starts, sizes, w: read.append(int(sizes.sum())) or sums(self, starts, sizes, w))
    found = index.nearest(queries)
    assert all(round(sim[0], 9) == 1 for _, sim in found)
    held = np.bincount(term)
    assert 0 < sum(read) < 0.2 * sum(held[term[owner == k][8:]].sum() for k in range(64))


def test_words_are_found_in_bulk(edge_rows, monkeypatch):
    """Against a dictionary, word by word; pieces and steps of a few bytes."""
    odd = ["", "_", "\u0130stanbul \u212aelvin \u00c0\u00df\u00b5\u00b2 a_b x\u00a0y\u0085z", "\u00c9t\u00c9 \u00aa", "na\u00efve\u2014\u4e2d\u6587 1\u00bd", "w" * 90 + " tail"]
    texts = [r[1] or "" for r in edge_rows] + odd
    split = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert [known_terms.words_of(t) for t in texts] == split
    words = sorted({w for s in split for w in s})
    known = {w: k for k, w in enumerate(words[::2])}
    want = [sorted(Counter(known[w] for w in s if w in known).items()) for s in split]
    for small in (False, True):
        if small:
            monkeypatch.setattr(known_terms, "PIECE", max(len(w.encode()) for w in words) + 2)
            monkeypatch.setattr(known_terms, "STEP", 50)
        terms = known_terms.Terms.of(list(known))
        owner, ids, counts = terms.counts(texts)
        got = [[] for _ in texts]
        for k, t, c in zip(owner.tolist(), ids.tolist(), counts.tolist(), strict=True):
            got[k].append((t, c))
        assert got == want
    assert [len(x) for x in known_terms.Terms.of([]).counts(texts)] == [0, 0, 0]


def test_votes_are_calibrated(corpus, index):
    """Among held-out rows, the mean score of low, middle and high scores is near the share that is toxic."""
    held = [r for r in corpus[2] if is_held_out(r[0])]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(corpus[0], index).collect()}
    error = 0.0
    for lo, hi in ((0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        inside = [(got[r[0]], r[4]) for r in held if lo <= got[r[0]] < hi]
        error += abs(sum(s - y for s, y in inside)) / len(held)
    assert error < 0.08


def test_toxicity_on_held_out_rows(corpus, index):
    got = {r["doc_id"]: r for r in toxicity.scored(corpus[0], index).collect()}
    held = [r for r in corpus[2] if is_held_out(r[0])]
    right = sum((got[r[0]]["score"] >= 0.5) == bool(r[4]) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= g["score"] <= 1 for g in got.values())
    assert all(not is_held_out(e["doc_id"]) for g in got.values() for e in g["evidence"])
    assert max(len(g["evidence"]) for g in got.values()) == toxicity.NEIGHBOURS


def test_toxicity_of_odd_inputs(spark, edge_docs, clashing_docs, empty_docs, edge_rows, edge_labels, index):
    own = toxicity.fit(edge_docs, edge_labels)
    assert toxicity.scored(clashing_docs, own).count() == len(edge_rows)
    none = toxicity.fit(edge_docs, edge_labels.limit(0))
    assert {r["score"] for r in toxicity.scored(edge_docs, none).collect()} == {0.0}
    assert toxicity.scored(empty_docs, toxicity.fit(empty_docs, edge_labels)).count() == 0
    kept = toxicity.without_toxic(clashing_docs, index)
    assert kept.columns == clashing_docs.columns and kept.count() == len(edge_rows)
    base = {r["score"] for r in toxicity.scored(edge_docs.filter("text is null or text = ''"), index).collect()}
    assert base == {index.base_rate}


def test_network_learns_and_is_deterministic(corpus):
    rows = [r for r in corpus[2] if not is_held_out(r[0])][:200]
    texts, y = [r[1].encode() for r in rows], np.array([r[3] for r in rows], float)
    net = quality_net.train(texts, y, y.mean(), 4)
    held = [r for r in corpus[2] if is_held_out(r[0])]
    p = net.score([r[1].encode() for r in held])
    assert ((p >= 0.5) == np.array([bool(r[3]) for r in held])).mean() >= 0.95
    assert np.array_equal(p, quality_net.train(texts, y, y.mean(), 4).score([r[1].encode() for r in held]))


def test_forward_pass_byte_by_byte():
    """Scores against a plain computation of every filter at every place."""
    rng = np.random.default_rng(12)
    train = [rng.integers(97, 105, n, dtype=np.uint8).tobytes() for n in (50, 300, 90, 10)]
    net = quality_net.train(train, np.array([0.0, 1.0, 1.0, 0.0]), 0.4, 1)
    gap, cell = quality_net.GAP, quality_net.CELL

    def score(text):
        cells = max(1, -(-len(text) // cell))
        code = lambda i: text[i] if 0 <= i < len(text) else gap

        def inputs(i):
            same = [float(i >= q and code(i) == code(i - q) != gap) for q in range(2, quality_net.LAGS + 1)]
            return np.concatenate([net.embed[code(i)], same])

        x = [inputs(i) for i in range(cells * cell + quality_net.WIDTH)]
        out = np.array([net.bias + sum(x[i + j] @ net.filters[j] for j in range(quality_net.WIDTH)) for i in range(cells * cell)])
        most = [np.maximum(out[c * cell : (c + 1) * cell].max(0), 0) for c in range(cells)]
        chunk = np.array([np.maximum(a, b) for a, b in zip(most, most[1:], strict=False)] or most)
        z = np.concatenate([chunk.mean(0), chunk.max(0)]) @ net.top[:-1] + net.top[-1] + net.shift
        return 1 / (1 + math.exp(-z))

    texts = [b"", b"a", rng.integers(97, 123, 127, dtype=np.uint8).tobytes(), bytes(range(256)) * 2, b"ab" * 200]
    assert np.allclose(net.score(texts), [score(t) for t in texts], atol=1e-5)


def test_network_gradients():
    """The backward pass against differences of the loss."""
    rng = np.random.default_rng(0)
    texts, y = [rng.integers(97, 110, n, dtype=np.uint8).tobytes() for n in (40, 300, 700)], np.array([0.0, 1.0, 0.0])
    net = quality_net.train(texts, y, 0.5, 0)
    net.filters, net.embed, net.bias = net.filters.astype(float), net.embed.astype(float), net.bias.astype(float)
    before = {k: getattr(net, k).copy() for k in ("filters", "embed", "bias", "top")}
    seen = {}
    moved = quality_net.train(texts, y, 0.5, 1)  # one step of one batch: its direction is the gradient's sign
    for k in before:
        seen[k] = np.sign(before[k] - getattr(moved, k))

    def loss():
        codes, first, cells = quality_net.layout(texts)
        z = net.logits(net.pooled(net.filtered(net.inputs(codes).astype(float)), first, cells)[0])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for name in ("top", "bias"):
        for at in list(np.ndindex(before[name].shape))[:12]:
            value = getattr(net, name)
            value[at] += 1e-4
            up = loss()
            value[at] -= 2e-4
            slope = (up - loss()) / 2e-4 + quality_net.DECAY * before[name][at]
            value[at] += 1e-4
            assert abs(slope) < 1e-5 or np.sign(slope) == seen[name][at]


def test_network_on_long_and_odd_texts(spark, edge_docs, clashing_docs, empty_docs, edge_rows, edge_labels):
    net = quality_net.fit(edge_docs, edge_labels)
    assert quality_net.scored(clashing_docs, net).count() == len(edge_rows)
    long = bytes(np.random.default_rng(1).integers(97, 123, 3 * quality_net.STEP + 77, dtype=np.uint8))
    codes, first, cells = quality_net.layout([long])
    whole = net.pooled(net.filtered(net.inputs(codes)), first, cells)[0]
    assert np.allclose(whole, net._long(long), atol=1e-3)
    assert quality_net.scored(empty_docs, net).count() == 0
    none = quality_net.fit(edge_docs, edge_labels.filter("quality = 1"))
    assert {r["score"] for r in quality_net.scored(edge_docs, none).collect()} == {1.0}


def slow_metrics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), dup, len(covered)


def test_rule_metrics(edge_rows):
    rng = random.Random(2)
    texts = [r[1] or "" for r in edge_rows if len(r[1] or "") < 5000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "#| ", "a a ", "\n", "é x "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert quality_rules.metrics_of(t)[:5] == slow_metrics(t)


def test_binomial_tail_and_choice():
    for n, x, p in ((50, 3, 0.1), (600, 0, 0.01), (10, 10, 0.2), (200, 7, 0.05)):
        exact = sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(x + 1))
        assert math.isclose(quality_rules.tail(x, n, p), float(exact), rel_tol=1e-9)
    levels = len(quality_rules.LEVELS["symbols"])
    assert quality_rules.chosen([0] * levels, [5] * levels, 10, 10, 0.01) is None  # too few holdouts certify nothing
    assert quality_rules.chosen([0] * levels, [1, 2, 9, 9] + [9] * (levels - 4), 5000, 10, 0.001) == 2
    assert quality_rules.chosen([0, 0, 400] + [400] * (levels - 3), [1, 2, 10] + [10] * (levels - 3), 5000, 10, 0.001) == 1


def test_false_rejections_are_limited():
    """Over many draws with a true rate above the limit at every level, certification almost never happens."""
    rng = np.random.default_rng(5)
    p = quality_rules.RISK / len(quality_rules.LEVELS)
    wrong = sum(quality_rules.chosen([int(rng.binomial(2000, 1.05 * p))] * 12, [9] * 12, 2000, 10, 0.05) is not None for _ in range(400))
    assert wrong <= 0.05 * 400


def test_rules_on_odd_inputs(edge_docs, clashing_docs, empty_docs, edge_rows, edge_labels):
    rows = quality_rules.measured(clashing_docs)
    out = quality_rules.judged(rows, quality_rules.thresholds(rows, edge_labels))
    assert out.count() == len(edge_rows) and out.filter("kept is null or (base_failed and kept)").count() == 0
    rows = quality_rules.measured(empty_docs)
    assert quality_rules.judged(rows, quality_rules.thresholds(rows, edge_labels)).count() == 0
