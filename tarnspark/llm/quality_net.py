"""Quality by a byte-level convolutional network in numpy.

Input of each byte: a learned embedding, and whether it equals the byte 2, 3, ... LAGS places before. Learned filters of
WIDTH bytes run over the whole document; each takes its greatest value in every chunk of two cells, chunks overlap by one
cell; the mean and the maximum over all chunks enter one logistic unit. Only bytes are seen.

The network is trained on the driver from a bounded sample of labelled rows (EXAMPLES of each class, fixed seed), and the
logit is corrected to the base rate of all labelled rows. Scoring streams whole texts in bounded steps.

Defined results: null and empty texts are scored as a document of no bytes; with labels of one class only (or none) every
score is the base rate; repeated rows score alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, text_or_empty
from tarnspark.llm.folds import held_out, label_counts, sample

#: Bounds of the fitted part: labelled examples of each class, bytes of all their texts that are trained on (half for each
#: class), of a text among them (longer ones are scored, not trained on), and of the texts of one batch.
EXAMPLES, TRAIN_BYTES, TRAIN_TEXT, BATCH_BYTES = 500, 6 << 20, 1 << 19, 1 << 19
EMBED, LAGS, WIDTH, FILTERS, CELL = 8, 17, 8, 16, 128
EPOCHS, BATCH, RATE, SEED, DECAY = 10, 16, 0.01, 7, 1e-4
#: Bytes of text in one numpy step.
STEP = 1 << 17
GAP = 256  # the code between documents


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with each document at the start of a cell and a cell of gaps behind it (no filter or lag sees two documents),
    first cell of each, and its number of cells."""
    sizes = np.array([len(t) for t in texts])
    room = np.maximum(1, -(-sizes // CELL)) + 1
    first = np.cumsum(room) - room
    codes = np.full(int(room.sum()) * CELL + WIDTH, GAP, np.int64)
    for t, c in zip(texts, first.tolist(), strict=True):
        codes[c * CELL : c * CELL + len(t)] = np.frombuffer(t, np.uint8)
    return codes, first, np.maximum(1, -(-sizes // CELL))


@dataclass
class Net:
    embed: np.ndarray  # (257, EMBED)
    filters: np.ndarray  # (WIDTH, channels, FILTERS)
    bias: np.ndarray
    top: np.ndarray  # (2 * FILTERS + 1,)
    shift: float  # of the logit, from the sample's rate to the base rate
    constant: float | None = None  # the score where nothing could be learned

    def inputs(self, codes: np.ndarray) -> np.ndarray:
        x = np.zeros((len(codes), EMBED + LAGS - 1), np.float32)
        x[:, :EMBED] = self.embed[codes]
        for q in range(2, LAGS + 1):
            x[q:, EMBED + q - 2] = (codes[q:] == codes[:-q]) & (codes[q:] != GAP)
        return x

    def filtered(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - WIDTH
        out = x[:n] @ self.filters[0]
        for j in range(1, WIDTH):
            out += x[j : j + n] @ self.filters[j]
        return out + self.bias

    def pooled(self, out: np.ndarray, first: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, 2 * FILTERS) features; rectified chunk maxima; the chunks' first rows of each document."""
        most = np.maximum(out.reshape(-1, CELL, FILTERS).max(1), 0)
        chunks = np.maximum(cells - 1, 1)
        begin = np.cumsum(chunks) - chunks
        cell = np.arange(int(chunks.sum())) + np.repeat(first - begin, chunks)
        pair = np.minimum(cell + 1, np.repeat(first + cells - 1, chunks))
        chunk = np.maximum(most[cell], most[pair])
        return np.concatenate([np.add.reduceat(chunk, begin) / chunks[:, None], np.maximum.reduceat(chunk, begin)], 1), chunk, begin

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.top[:-1] + self.top[-1] + self.shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        ends, a = np.cumsum([len(t) + CELL for t in texts]), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
            out[a:b] = self._features(texts[a:b]) @ self.top[:-1] + self.top[-1] + self.shift
            a = b
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def _features(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > 2 * STEP:
            return self._long(texts[0])
        codes, first, cells = layout(texts)
        return self.pooled(self.filtered(self.inputs(codes)), first, cells)[0]

    def _long(self, text: bytes) -> np.ndarray:
        """As for others, in parts of STEP bytes that carry the bytes around them."""
        cells = -(-len(text) // CELL)
        most = np.zeros((cells, FILTERS), np.float32)
        for a in range(0, cells * CELL, STEP):
            lead = min(a, CELL)
            part = text[a - lead : a + STEP + WIDTH]
            codes = np.full(lead + STEP + 2 * WIDTH, GAP, np.int64)
            codes[: len(part)] = np.frombuffer(part, np.uint8)
            out = self.filtered(self.inputs(codes))[lead : lead + STEP]
            n = min(STEP // CELL, cells - a // CELL)
            most[a // CELL : a // CELL + n] = np.maximum(out.reshape(-1, CELL, FILTERS).max(1), 0)[:n]
        chunk = np.maximum(most[:-1], most[1:])
        return np.concatenate([chunk.mean(0), chunk.max(0)])[None]


def _batches(order: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
    rows, size = [], 0
    for k in order.tolist():
        if rows and (len(rows) == BATCH or size + len(texts[k]) > BATCH_BYTES):
            yield np.array(rows)
            rows, size = [], 0
        rows.append(k)
        size += len(texts[k])
    if rows:
        yield np.array(rows)


def train(texts: list[bytes], y: np.ndarray, base_rate: float, epochs: int = EPOCHS) -> Net:
    """Adam on the logistic loss; deterministic."""
    rng = np.random.default_rng(SEED)
    channels = EMBED + LAGS - 1
    embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
    embed[GAP] = 0
    net = Net(embed, rng.normal(0, 1 / np.sqrt(WIDTH * channels / 2), (WIDTH, channels, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS + 1), 0.0)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for rows in _batches(order, texts):
            codes, first, cells = layout([texts[k] for k in rows])
            x = net.inputs(codes)
            out = net.filtered(x)
            feats, chunk, begin = net.pooled(out, first, cells)
            p = 1 / (1 + np.exp(-np.clip(net.logits(feats), -30, 30)))
            error = (p - y[rows]) / len(rows)
            chunks = np.diff(np.append(begin, len(chunk)))
            doc = np.repeat(np.arange(len(rows)), chunks)
            back = error[doc, None] * net.top[:FILTERS] / chunks[doc, None]
            top_chunk = np.stack([begin[d] + chunk[begin[d] : begin[d] + chunks[d]].argmax(0) for d in range(len(rows))])
            np.add.at(back, (top_chunk, np.arange(FILTERS)), error[:, None] * net.top[FILTERS:-1])
            cell = np.arange(len(chunk)) + np.repeat(first - begin, chunks)
            pair = np.minimum(cell + 1, np.repeat(first + cells - 1, chunks))
            grid = out.reshape(-1, CELL, FILTERS)
            best = grid.argmax(1)
            most = np.take_along_axis(grid, best[:, None], 1)[:, 0]
            source = np.where(most[cell] >= most[pair], cell[:, None], pair[:, None])
            at = source * CELL + np.take_along_axis(best, source, 0)
            back = back * (chunk > 0)
            taps = at[..., None] + np.arange(WIDTH)
            grad_filters = np.einsum("cf,cfjk->jkf", back, x[taps])
            spread = np.einsum("cf,jkf->cfjk", back, net.filters[:, :EMBED])
            grad_embed = np.zeros_like(net.embed, np.float64)
            np.add.at(grad_embed, codes[taps].ravel(), spread.reshape(-1, EMBED))
            grad_embed[GAP] = 0
            step += 1
            for name, grad in (("filters", grad_filters), ("embed", grad_embed), ("bias", back.sum(0)), ("top", np.append(error @ feats, error.sum()))):
                value = getattr(net, name)
                grad = grad + DECAY * value
                m, v = moments.get(name, (np.zeros(value.shape), np.zeros(value.shape)))
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                moments[name] = m, v
                rate = RATE * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
                setattr(net, name, (value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(value.dtype))
    share = y.mean()
    net.shift = float(np.log(base_rate / (1 - base_rate)) - np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Net:
    bounded_batches(docs.sparkSession)
    n0, n1 = label_counts(labels, column)
    rows = sample(docs, labels, column, EXAMPLES, TRAIN_TEXT, TRAIN_BYTES // 2).toArrow().sort_by([("doc_id", "ascending")])
    y = rows.column("y").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return Net(*[np.zeros(0)] * 4, 0.0, n1 / max(1, n0 + n1))
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    return train(texts, y, n1 / (n0 + n1))


def _score_rows(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(shared.value.score([t.encode() for t in b.column(1).to_pylist()]))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_score_rows(shared), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
