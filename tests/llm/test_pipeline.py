"""The pipeline against brute force, stage by stage, each on its predecessor's output."""

import random
from collections import Counter

import sentencepiece

import corpus_pipeline
from tarnspark.llm import sentence_pieces, toxicity
from tarnspark.llm.common import stored
from tests.llm.test_chat_and_mixing import slow_mix
from tests.llm.test_dedup import slow_components, slow_fingerprint, slow_word_repeats


def corpus(rng):
    words = ["".join(rng.choice("abcdefghilmnoprstuéü") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    passage = " ".join(rng.choice(words) for _ in range(110))
    rows, labels = [], []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(20, 160))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(6):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron"]))
        if k % 10 == 3:
            text.insert(5, passage)
        rows.append((k, " ".join(text), "en", f"s{min(3, k % 7)}", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(200 + k, rows[k][1], "en", "s0", 0) for k in range(12)] + [(230, None, None, None, None), (231, "", "en", None, 0), (None, passage, "de", "s1", 0), rows[9]]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus(random.Random(21))
    sf_dir = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = stored(stage["toxicity"](spark, docs, sf_dir), "t")
    want = Counter()
    for r in rows:
        ids, w = index.query(r[1] or "")
        w, sims = dict(zip(ids.tolist(), w.tolist(), strict=True)), {}  # cosine with every example, from all its terms
        for e in range(len(index.y)):
            own = slice(index.start[e], index.start[e + 1])
            x = sum(w.get(t, 0.0) * v for t, v in zip(index.own[own].tolist(), index.own_weight[own].tolist(), strict=True))
            if x:
                sims[e] = x
        near = sorted(sims, key=lambda e: (-round(sims[e], 12), e))[: toxicity.NEIGHBOURS]
        votes = [(sims[e] ** 2 * index.stands_for[index.y[e]], index.y[e]) for e in near]
        score = (sum(v * y for v, y in votes) + toxicity.PRIOR_WEIGHT * index.base_rate) / (sum(v for v, _ in votes) + toxicity.PRIOR_WEIGHT)
        want[r[0], r[1]] += score < 0.5
    assert pairs(clean) == +want and clean.columns == docs.columns
    gone = {r[0] for r in rows if r[0] is not None} - {k[0] for k in pairs(clean)}
    assert {k for k in range(0, 150, 6)} & gone and sum(k % 6 != 0 for k in gone if k < 150) <= 3

    once = stored(stage["simhash_near_dedup"](spark, clean, sf_dir), "t")
    had = [(r["doc_id"], r["text"]) for r in clean.collect()]
    root = slow_components([slow_fingerprint(t) for _, t in had])
    assert once.count() == len(set(root)) and not pairs(once) - Counter(had)
    groups = {}
    for (d, _), k in zip(had, root, strict=True):
        groups.setdefault(k, []).append(d)
    assert Counter(r["doc_id"] for r in once.collect()) == Counter(min((d for d in g), key=lambda d: (d is not None, d or 0)) for g in groups.values())

    cut = stored(stage["suffix_array_dedup"](spark, once, sf_dir), "t")
    had = [(r["doc_id"], r["text"]) for r in once.collect()]
    left = {r["doc_id"]: r for r in cut.collect()}
    want = {d: w for (d, t), w in zip(had, slow_word_repeats([t for _, t in had]), strict=True) if w == t or w.strip()}
    assert len(left) == cut.count() and {d: r["text"] for d, r in left.items()} == want
    assert sum(t != want.get(d) for d, t in had) > 5
    assert all(r["n_chars"] == len(r["text"]) for d, r in left.items() if (d, r["text"]) not in had)

    mix = stored(stage["mixing"](spark, cut, sf_dir), "t")
    had = [(r["doc_id"], r["source"], r["text"]) for r in cut.collect()]
    want = Counter()
    for r, (n, _, _, taken) in zip(had, slow_mix(had), strict=True):
        want[r[0], r[2]] += int(taken / n + 0.5) if n else 0
    assert pairs(mix) == +want and mix.columns == docs.columns

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    ids = stage["sentencepiece"](spark, mix, sf_dir)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in mix.collect())

    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in whole.collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect())


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
