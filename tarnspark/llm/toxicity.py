"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are lower-cased words, known by 64-bit hashes. The examples are a bounded sample of labelled rows; every example and
every one of its terms is indexed. A term weighs (1 + log count) times its inverse document frequency, counted over all
documents, times its correlation with the labels of the examples (the phi coefficient): without that factor topics outweigh
the few words that make a text toxic. Terms of no example correlate with nothing and weigh 0. Cosine is exact in this space.

The index holds postings by term, examples in blocks, and the greatest weight of terms in each block. The most frequent
terms, which occur in most blocks, are kept as rows of a matrix: their share of all similarities comes from one product for a
batch of texts, in single precision. Of rare terms, whose greatest weights would take as much room as their postings, these
are read whole. A block's bound is the greatest sum of both in it plus what the terms between can add at most (one product
for a batch, too); their postings are read in the blocks whose bound reaches the k-th best similarity known, or whole if
these blocks are many. For the examples that may be among the k best, allowing for single precision, the share of the
frequent terms is then summed exactly, term by term, so neighbours are exact; ties go to the earlier example.

Score: votes weighted by squared similarity and by what each class's examples stand for, drawn to the base rate by a
prior weight. Evidence: the examples that vote, with their similarities and labels.

Defined results: a null or empty text, or one without known terms, has the base rate as its score and no evidence; with no
usable labels every score is 0, and with one class only it is the base rate; repeated rows score alike; empty tables give no
rows; other columns are ignored by `scored` and pass through `without_toxic`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, ranges, stored, text_or_empty, trimmed
from tarnspark.llm.folds import held_out, label_counts, sample
from tarnspark.llm.known_terms import Terms, words_of

#: Bounds of the fitted part: labelled examples of each class, bytes of one's text (longer ones are scored, not learned
#: from) and of all texts of a class. They bound the index, too.
EXAMPLES, EXAMPLE_BYTES, CLASS_BYTES = 4000, 1 << 18, 16 << 20
NEIGHBOURS, PRIOR_WEIGHT = 15, 0.05
BLOCK = 16
#: Terms kept as rows of a matrix, these and the next most frequent ones, whose greatest weights in each block are kept, and
#: more than sums can be off in single precision.
HEAD, BOUNDED, SLACK = 512, 2048, 1e-4
#: Share of the blocks up to which postings are picked block by block.
FEW = 0.1
#: Texts whose words are looked up, and that are scored, in one go.
STEP_TEXTS = 256

def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(sorted({w for t in b.column(0).to_pylist() for w in words_of(t)}), pa.string())], names=["term"])


def _count_rows(terms) -> Callable:
    """(doc_id, y, text) -> (doc_id, y, ids of its terms, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, ids, counts = terms.value.counts(b.column(2).to_pylist())
            start = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(start, pa.array(x.astype(np.int32))) for x in (ids, counts)]
            yield pa.record_batch([b.column(0), b.column(1), *lists], names=["doc_id", "y", "ids", "counts"])

    return run


def _frequency_rows(terms) -> Callable:
    """(text) -> in how many texts of this task each known term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms.value), np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for a in range(0, len(texts), STEP_TEXTS):
                df += np.bincount(terms.value.counts(texts[a : a + STEP_TEXTS])[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


@dataclass
class Index:
    """Block-max inverted index of the examples, and what votes need. Bounded by the bounds of the examples."""

    terms: Terms  # those of most examples first
    factor: np.ndarray  # inverse document frequency times correlation, of each term
    example: np.ndarray  # doc_id of each example
    y: np.ndarray
    stands_for: np.ndarray  # labelled rows that an example of class 0, 1 stands for
    base_rate: float
    doc: np.ndarray  # postings but of frequent terms: example numbers, term after term, ascending
    weight: np.ndarray
    first: np.ndarray  # where each term's postings begin
    head: np.ndarray  # (first terms, examples): weights
    most: np.ndarray  # (next terms, blocks): greatest weights
    cut: np.ndarray  # (next terms, blocks + 1): where each block's postings begin
    start: np.ndarray  # where each example's own terms begin
    own: np.ndarray  # frequent terms of the examples, example after example
    own_weight: np.ndarray
    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, weights) the k examples of highest cosine, best first (fewer if fewer share a term that
        weighs), exactly."""
        none = (np.zeros(0, np.int64), np.zeros(0))
        if not len(self.y):
            return [none] * len(queries)
        h = len(self.head)
        rows = np.zeros((len(queries), h + len(self.most)), np.float32)
        for q, (ids, w) in enumerate(queries):
            some = np.searchsorted(ids, rows.shape[1])
            rows[q, ids[:some]] = w[:some]
        shares, bounds, dense = rows[:, :h] @ self.head, rows[:, h:] @ self.most, np.zeros(h)
        return [self._nearest(ids, w, share, bound, dense, k) if len(ids) else none for (ids, w), share, bound in zip(queries, shares, bounds, strict=True)]

    def _sums(self, starts: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What lists of postings, with these weights of their terms, add to the similarity of each example."""
        at = ranges(starts, sizes)
        return np.bincount(self.doc[at], self.weight[at] * np.repeat(w, sizes), len(self.y))

    def _nearest(self, ids: np.ndarray, w: np.ndarray, share: np.ndarray, bound: np.ndarray, dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """share: similarities by frequent terms alone; bound: what the next terms can add in each block; dense: a vector of
        zeros over the frequent terms, which is left as it was."""
        h, n = len(self.head), len(share)
        first, last = np.searchsorted(ids, (h, h + len(self.most)))
        starts = self.first[ids[last:]]
        rest = self._sums(starts, self.first[ids[last:] + 1] - starts, w[last:])
        top = np.maximum.reduceat(share + rest, np.arange(0, n, BLOCK))
        kth = np.partition(top, -k)[-k] if len(top) >= k else 0.0  # k examples are at least as near
        live = np.flatnonzero(top + bound >= kth - SLACK)
        lists, add = ids[first:last], w[first:last]
        if len(live) > FEW * len(top):  # to pick the postings of most blocks takes longer than to read them all
            starts = self.first[lists]
            sizes = self.first[lists + 1] - starts
        else:
            starts = self.cut[lists[:, None] - h, live]
            sizes = self.cut[lists[:, None] - h, live + 1] - starts
            term, block = np.nonzero(sizes)
            starts, sizes, add = starts[term, block], sizes[term, block], add[term]
        rest = rest + self._sums(starts, sizes, add)
        sim = share + rest
        found = np.flatnonzero(sim >= max(kth - 2 * SLACK, 1e-300))
        if len(found) > k:
            near = sim[found]
            found = found[near >= np.partition(near, -k)[-k] - 2 * SLACK]
        dense[ids[:first]] = w[:first]
        starts = self.start[found]
        sizes = self.start[found + 1] - starts
        at = ranges(starts, sizes)
        exact = rest[found] + np.bincount(np.repeat(np.arange(len(found)), sizes), dense[self.own[at]] * self.own_weight[at], len(found))
        dense[ids[:first]] = 0
        best = np.lexsort((found, -np.round(exact, 12)))[:k]
        best = best[exact[best] > 0]
        return found[best], exact[best]

    def score(self, found: np.ndarray, sim: np.ndarray) -> float:
        vote = sim * sim * self.stands_for[self.y[found]]
        return float((vote @ self.y[found] + PRIOR_WEIGHT * self.base_rate) / (vote.sum() + PRIOR_WEIGHT))

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's known terms that weigh, ascending, and their weights."""
        return self.queries([text])[0]

    def queries(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, ids, counts = self.terms.counts(texts)
        factor = self.factor[ids]
        owner, ids, w = owner[factor > 0], ids[factor > 0], ((1 + np.log(counts)) * factor)[factor > 0]
        w /= np.sqrt(np.bincount(owner, w * w, len(texts)))[owner]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        return [(ids[a:b], w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def phi(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Correlation, without its sign, of a term in a of n1 and b of n0 examples with their class."""
    spread = (a + b) * (n0 + n1 - a - b) * float(n0) * n1
    return np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(np.where(spread > 0, spread, np.inf))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Index:
    spark = docs.sparkSession
    bounded_batches(spark)
    n0, n1 = label_counts(labels, column)
    examples = stored(sample(docs, labels, column, EXAMPLES, EXAMPLE_BYTES, CLASS_BYTES), "examples")
    words = examples.select("text").mapInArrow(trimmed(_word_rows), "term string").distinct().toArrow().column("term").to_pylist()
    terms = Terms.of(sorted(words))
    known = spark.sparkContext.broadcast(terms)
    found = docs.select(text_or_empty().alias("text")).mapInArrow(trimmed(_frequency_rows(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(terms))
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    rows = examples.mapInArrow(trimmed(_count_rows(known)), "doc_id long, y int, ids array<int>, counts array<int>").toArrow().sort_by([("y", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    y, lists = rows.column("y").to_numpy().astype(np.int64), [rows.column(c).combine_chunks() for c in ("ids", "counts")]
    owner = np.repeat(np.arange(len(y)), pc.list_value_length(lists[0]).to_numpy())
    term, count = (x.flatten().to_numpy() for x in lists)
    known.unpersist()
    return _index(terms, df, docs.count(), rows.column("doc_id").to_numpy(), y, owner, term.astype(np.int64), count, np.array([n0, n1]))


def _index(terms: Terms, df: np.ndarray, total: int, example: np.ndarray, y: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray, labelled: np.ndarray) -> Index:
    """From the terms (owner, term, count) of the examples, in order of their owners."""
    a, b = (np.bincount(term[y[owner] == k], minlength=len(terms)).astype(float) for k in (1, 0))
    each = np.bincount(y, minlength=2)
    factor = np.log((1 + total) / (1 + df)) * phi(a, b, int(each[1]), int(each[0]))
    w = (1 + np.log(count)) * factor[term]
    norm = np.sqrt(np.bincount(owner, w * w, len(y)))
    w = w / np.where(norm > 0, norm, 1)[owner]
    by = np.lexsort((term, w, owner))
    heaviest = np.zeros(len(y), np.int64)  # examples alike lie in one block
    heaviest[owner[by]] = term[by]
    order = np.lexsort((np.arange(len(y)), heaviest, y))
    place = np.empty(len(y), np.int64)
    place[order] = np.arange(len(y))
    live = w > 0
    term, doc, w = term[live], place[owner][live], w[live]
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(-np.bincount(term, minlength=len(terms)), kind="stable")] = np.arange(len(terms))
    terms, term = terms.renumbered(rank), rank[term]
    factor[rank] = factor.copy()
    h, bounded = min(HEAD, len(terms)), min(BOUNDED, len(terms))
    frequent, rest = np.flatnonzero(term < h), np.flatnonzero(term >= h)
    head = np.zeros((h, len(y)), np.float32)
    head[term[frequent], doc[frequent]] = w[frequent]
    by = frequent[np.lexsort((term[frequent], doc[frequent]))]
    own, own_weight, start = term[by].astype(np.int32), w[by], np.searchsorted(doc[by], np.arange(len(y) + 1))
    by = rest[np.lexsort((doc[rest], term[rest]))]
    term, doc, w = term[by], doc[by].astype(np.int32), w[by]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks = max(1, -(-len(y) // BLOCK))
    most, cut = np.zeros((bounded - h, blocks), np.float32), np.zeros((bounded - h, blocks + 1), np.int32)
    for t in range(h, bounded):
        a, b = first[t], first[t + 1]
        np.maximum.at(most[t - h], doc[a:b] // BLOCK, w[a:b].astype(np.float32))
        cut[t - h] = a + np.searchsorted(doc[a:b], np.arange(blocks + 1) * BLOCK)
    stands = labelled / np.maximum(each, 1)
    return Index(terms, factor, example[order], y[order], stands / max(stands.min(), 1e-9), labelled[1] / max(1, labelled.sum()), doc, w, first, head, most, cut, start, own, own_weight)


_EVIDENCE = pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])
_EVIDENCE_SQL = "array<struct<doc_id:long,similarity:double,label:int>>"


def _score_rows(shared: Broadcast) -> Callable:
    """The last column is the text; it gives way to score and evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            scores, found, sims = [], [], []
            for a in range(0, len(texts), STEP_TEXTS):
                for near, sim in index.nearest(index.queries([t or "" for t in texts[a : a + STEP_TEXTS]])):
                    scores.append(index.score(near, sim))
                    found.append(near)
                    sims.append(sim)
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            voters = pa.StructArray.from_arrays([pa.array(index.example[flat]), pa.array(np.concatenate([np.zeros(0), *sims])), pa.array(index.y[flat].astype(np.int32))], fields=list(_EVIDENCE))
            evidence = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)), voters)
            yield pa.record_batch([*b.columns[:-1], pa.array(scores, pa.float64()), evidence], names=[*b.schema.names[:-1], "score", "evidence"])

    return run


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(_score_rows(shared)), f"doc_id long, score double, evidence {_EVIDENCE_SQL}")


def without_toxic(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; columns as they were."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [f"c{k}" for k in range(len(docs.columns))]
    wide = docs.toDF(*names).withColumn("_text", F.col(names[docs.columns.index("text")]))
    types = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    kept = wide.mapInArrow(trimmed(_score_rows(shared)), f"{types}, score double, evidence {_EVIDENCE_SQL}").filter(F.col("score") < threshold)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, index).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
