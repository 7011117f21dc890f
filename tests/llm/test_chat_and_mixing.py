"""Chat formatting against a fold in Python, mixing against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

from tarnspark.llm import chat, mixing


def test_escaping_is_reversible(spark):
    rng = random.Random(1)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    turns = spark.createDataFrame([(1, k, rng.choice(["user", "assistant", "a\nb", "[/INST]", ""]), t) for k, t in enumerate(texts)], "conv_id long, place long, role string, text string")
    rows = chat.rendered(turns).orderBy("place").collect()
    assert list(chat.parsed("".join(r["piece"] for r in rows))) == [(r["role"], r["text"]) for r in rows]
    for r in rows:
        inside = r["piece"][r["loss_from"] : r["loss_from"] + r["loss_chars"]]
        assert chat.unescaped(inside) == (r["text"] if r["role"] == "assistant" else "")


def test_folding_of_events(spark):
    log = [
        (1, 0, "u", "delta", "user", "hel"), (1, 1, "u", "delta", "user", "lo"), (1, 2, "a", "delta", "assistant", "bad"), (1, 3, "a", "regenerate", "assistant", "go"),
        (1, 4, "a", "delta", "assistant", "od"), (1, 5, "u", "edit", "user", "hello!"), (1, 6, "u", "delta", "user", "?"), (2, 1, "x", None, None, None),
    ]
    rng = random.Random(3)
    rng.shuffle(log)
    got = chat.messages(spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "hello!?"), (1, 2, "assistant", "good"), (2, 1, "", "")]


def test_logs_fold_back_to_their_transcripts(spark):
    rng = random.Random(6)
    rows = [(k % 7, k // 7, rng.choice(["user", "assistant"]), "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 30)))) for k in range(140)]
    rows += rows[:5] + [(1, None, None, None), (None, 3, "user", "x"), (1, 2**60, "user", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.log_of(df).collect()
    assert {r["kind"] for r in log} == {"delta", "edit", "regenerate"} and len(log) > 2 * len(rows)
    assert [r["seq"]["step"] for r in log] != sorted(r["seq"]["step"] for r in log)
    assert sorted(map(repr, map(tuple, log))) == sorted(map(repr, map(tuple, chat.log_of(df.repartition(5)).collect())))
    got = sorted(repr((r["conv_id"], r["place"]["turn"], r["role"], r["text"])) for r in chat.messages(chat.log_of(df)).collect())
    assert got == sorted(repr((c, t, role or "", text or "")) for c, t, role, text in rows)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a</s>"), (1, 1, "assistant", "a</s>"), (1, 1, "user", None), (None, None, None, None), (None, 2, "assistant", "x" * 50_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS piece").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.rendered(chat.messages(chat.log_of(df)))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.rendered(chat.messages(chat.log_of(df.limit(0))))).count() == 0


def slow_mix(rows):
    """(doc_id, source, text) -> per row (size, source size, target, taken), by repeated resharing and a full sort."""
    size = [len(re.findall(mixing.WORD, t or "")) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    limited = set()
    while True:
        rest = sum(size) - sum(3 * total[s] for s in limited)
        free = sum(weight[s] for s in sources if s not in limited)
        target = {s: 3.0 * total[s] if s in limited else weight[s] * rest / free for s in sources}
        over = {s for s in sources if s not in limited and target[s] > 3 * total[s]}
        if not over:
            break
        limited |= over

    def key(doc_id, text):
        u = (int(hashlib.md5(f"mix|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        text = text or ""
        q = 1.0 if not text else sum(c not in mixing.SYMBOLS for c in text) / len(text)
        return -math.log(u) / (0.1 + 0.9 * q * q)

    out = [None] * len(rows)
    for s in sources:
        own = [k for k, r in enumerate(rows) if r[1] == s]
        epochs = min(3, int(target[s] // total[s])) if total[s] else 0
        left = math.floor(target[s] - epochs * total[s] + 0.5)
        groups = defaultdict(list)
        for k in own:
            groups[key(rows[k][0], rows[k][2]), -(2**63) if rows[k][0] is None else rows[k][0], size[k]].append(k)
        for (_, _, n), ks in sorted(groups.items()):
            more = min(n, max(0, left) // len(ks)) if left < n * len(ks) else n
            left -= n * len(ks)
            for k in ks:
                out[k] = (size[k], total[s], target[s], epochs * size[k] + more)
    return out


def check_mix(got, rows):
    want = sorted(((-1 if r[0] is None else r[0], *x) for r, x in zip(rows, slow_mix(rows), strict=True)), key=repr)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["_size"], r["source_size"], r["target"], r["taken"]) for r in got), key=repr)
    assert [(*w[:3], w[4]) for w in want] == [(*g[:3], g[4]) for g in got]
    assert all(math.isclose(w[3], g[3], rel_tol=1e-12) for w, g in zip(want, got, strict=True))


def test_mix_against_brute_force(spark, edge_rows, edge_docs, clashing_docs, empty_docs, monkeypatch):
    check_mix(mixing.assign(mixing.prepared(edge_docs)).collect(), [(r[0], r[3], r[1]) for r in edge_rows])
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # as for very many sources
    check_mix(mixing.assign(mixing.prepared(edge_docs)).collect(), [(r[0], r[3], r[1]) for r in edge_rows])
    mixed = mixing.mixed_documents(clashing_docs)
    assert mixed.columns == clashing_docs.columns and mixed.count() > 0
    assert mixing.assign(mixing.prepared(empty_docs)).count() == 0


def test_hot_and_tiny_sources(spark):
    rng = random.Random(9)
    rows = [(k, "hot", "w " * rng.randint(0, 30)) for k in range(900)] + [(1000 + k, f"t{k}", "a b c") for k in range(20)] + [(2000, "zz", "w " * 20_000), (2001, None, "$ # w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.assign(mixing.prepared(df)).collect()
    check_mix(got, rows)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["_size"])
        assert r["taken"] <= 3 * r["_size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.assign(mixing.prepared(df.repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
