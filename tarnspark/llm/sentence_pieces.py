"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are joined into one text; its suffixes are sorted to the depth of the longest piece; a binary
search of every piece, character by character, gives the range of suffixes that begin with it, and so all its
occurrences. These edges, sorted by position, say in constant time which piece, if any, spans two given places. They are
then relaxed in the order that the model prescribes: the public model is a BPE model, for which the path of greatest summed
score is not the right answer, so relaxing takes, word by word, the adjacent pair of symbols whose joint edge has the best
score (the leftmost of equals) until no pair has one. Words are independent: no piece has a space after another character.
What no piece covers becomes byte pieces. Ids equal those of the sentencepiece library.

Normalisation is the model's: identity, a space in front, spaces written as U+2581. Decoding joins pieces and bytes and
drops the space in front; every text without U+2581 comes back exactly (U+2581 itself is read as a space).

Defined results: a null text counts as empty and has no ids; repeated rows are encoded alike; null doc_id and empty tables
need no care; extra columns pass through `encoded`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, text_or_empty, trimmed
from tarnspark.llm.word_table import WordTable, cut

SPACE = "▁"
KEPT_WORDS = 500_000
#: Characters of text in one step, and of new words under one suffix array.
STEP_CHARS, INDEX_CHARS = 1 << 20, 1 << 19
#: Words up to this length are relaxed together; longer ones each with a heap.
SHORT = 48
_NONE = np.int64(1) << 40


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of text in the order of their first depth characters: as many characters as a word holds are
    sorted at once, then by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(rank.max(initial=1)).bit_length()
    k, key = min(depth, 62 // bits), rank.copy()
    for j in range(1, k):
        key <<= bits
        key[:-j] |= rank[j:]
    while True:
        order = np.argsort(key)
        if k >= depth:
            return order
        key = key[order]
        rank[order] = np.cumsum(np.append(1, key[1:] != key[:-1]))
        key = rank * (len(rank) + 2)
        key[:-k] += rank[k:]
        k *= 2


class Pieces:
    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        self.bytes_of = [bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.is_byte(k) else b"" if m.is_control(k) else m.id_to_piece(k).replace(SPACE, " ").encode() for k in every]
        self.byte_id = np.zeros(256, np.uint32)
        for k in every:
            if m.is_byte(k):
                self.byte_id[self.bytes_of[k][0]] = k
        own = [k for k in every if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k))]
        words = [m.id_to_piece(k) for k in own]
        if any(SPACE in w.lstrip(SPACE) or "\n" in w for w in words):
            raise ValueError("a piece spans words or lines: words would not be independent")
        self.id = np.array(own, np.uint32)
        self.size = np.array([len(w) for w in words])
        self.depth = int(self.size.max())
        scores = np.array([m.get_score(k) for k in own])
        self.rank = np.searchsorted(np.unique(-scores), -scores)
        self.chars = np.zeros((len(words), self.depth), np.uint32)
        for k, w in enumerate(words):
            self.chars[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        self.table = WordTable(self.encode_words, kept_words)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and piece numbers of all occurrences of all pieces in text, sorted by position, then length."""
        order = suffix_array(text, self.depth)
        ended = np.append(text, np.zeros(self.depth, np.uint32))
        lo, hi = np.zeros(len(self.size), np.int64), np.full(len(self.size), len(order))
        for d in range(self.depth):
            live = np.flatnonzero((self.size > d) & (lo < hi))
            want = self.chars[live, d]
            edge = []
            for past in (False, True):  # first suffix whose character d is not below want, or is above it
                a, b = lo[live].copy(), hi[live].copy()
                while (open_ := np.flatnonzero(a < b)).size:
                    mid = (a[open_] + b[open_]) >> 1
                    at = ended[order[mid] + d]
                    below = at <= want[open_] if past else at < want[open_]
                    a[open_[below]] = mid[below] + 1
                    b[open_[~below]] = mid[~below]
                edge.append(a)
            lo[live], hi[live] = edge
        count = hi - lo
        piece = np.repeat(np.arange(len(count)), count)
        ends = np.cumsum(count)
        position = order[np.arange(int(ends[-1])) + np.repeat(lo - (ends - count), count)]
        by = np.argsort(position * (self.depth + 1) + self.size[piece])
        return position[by], piece[by]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._encode(words[a:b]) for a, b in cut(np.cumsum([len(w) + 1 for w in words]), INDEX_CHARS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer("\x00".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words])
        begins = np.cumsum(sizes + 1) - sizes - 1
        position, piece = self.occurrences(text)
        first = np.searchsorted(position, np.arange(len(text) + 1))
        spans = np.zeros(len(text), np.int64)  # bit n: a piece of n characters begins here
        np.bitwise_or.at(spans, position, np.int64(1) << self.size[piece])

        def edge(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Index into the sorted edges of the piece over start, start + size; whether there is one."""
            size = np.minimum(size, self.depth + 1)
            bit = np.int64(1) << size
            there = (spans[start] & bit) != 0
            return first[start] + np.bitwise_count(spans[start] & (bit - 1)).astype(np.int64), there

        starts, lengths, owners = [], [], []
        live = np.flatnonzero(sizes <= SHORT)
        n = sizes[live]
        owner = np.repeat(live, n)
        start = np.repeat(begins[live] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        size = np.ones(len(start), np.int64)
        while len(start):
            pair = np.full(len(start), _NONE)
            joint = np.flatnonzero(owner[:-1] == owner[1:])
            at, there = edge(start[joint], size[joint] + size[joint + 1])
            pair[joint[there]] = self.rank[piece[at[there]]]
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(pair * (1 << 22) + np.arange(len(pair)), head)
            count = np.diff(np.append(head, len(start)))
            done = np.repeat(best >= _NONE * (1 << 22), count)
            starts.append(start[done])
            lengths.append(size[done])
            owners.append(owner[done])
            merge = best[best < _NONE * (1 << 22)] & ((1 << 22) - 1)
            size[merge] += size[merge + 1]
            keep = ~done
            keep[merge + 1] = False
            start, size, owner = start[keep], size[keep], owner[keep]
        for k in np.flatnonzero(sizes > SHORT).tolist():
            s, z = self._long(int(begins[k]), int(sizes[k]), edge, piece)
            starts.append(s)
            lengths.append(z)
            owners.append(np.full(len(s), k))
        start, size, owner = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owners)
        by = np.argsort(start, kind="stable")
        start, size, owner = start[by], size[by], owner[by]
        at, there = edge(start, size)
        ids = np.zeros(len(start), np.uint32)
        ids[there] = self.id[piece[at[there]]]
        width = np.ones(len(start), np.int64)
        lone = np.flatnonzero(~there)  # single characters without a piece: their bytes
        raw = [chr(c).encode() for c in text[start[lone]].tolist()]
        width[lone] = [len(r) for r in raw]
        out = np.repeat(ids, width)
        if len(lone):
            ends = np.cumsum(width)
            place = np.concatenate([np.arange(e - w, e) for e, w in zip(ends[lone].tolist(), width[lone].tolist(), strict=True)])
            out[place] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(owner, width, len(words)).astype(np.int64)

    def _long(self, begin: int, n: int, edge: Callable, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the symbols of one long word: the same merges, from a heap."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        at, there = edge(begin + np.arange(n - 1), np.full(n - 1, 2))
        heap = [(int(self.rank[piece[at[i]]]), i, 1, 1) for i in np.flatnonzero(there).tolist()]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and size[i] + size[j] <= self.depth:
                a, t = edge(np.array([begin + i]), np.array([size[i] + size[j]]))
                if t[0]:
                    heapq.heappush(heap, (int(self.rank[piece[a[0]]]), i, size[i], size[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b or a == 0:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        s = np.flatnonzero(np.array(size))
        return begin + s, np.array(size)[s]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each."""
        flat, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for a, b in cut(np.cumsum([len(t) + 1 for t in texts]), STEP_CHARS):
            units = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[a:b]]
            ids, n = self.table.encode([u for s in units for u in s], np.array([len(s) for s in units]))
            flat.append(ids)
            counts[a:b] = n
        return np.concatenate(flat), counts

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with their ids (array<int>) in place of the text column, which becomes `ids`; others as they were, but for one
    that is called ids already: it becomes `ids_before`."""
    bounded_batches(docs.sparkSession)
    docs = docs.withColumnRenamed("ids", "ids_before")
    k = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = pieces(path).encode([t or "" for t in b.column(k).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.record_batch([ids if i == k else b.column(i) for i in range(b.num_columns)], names=names)

    names = [f"c{i}" for i in range(len(docs.columns))]
    types = ", ".join(f"c{i} {'array<int>' if i == k else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return docs.toDF(*names).mapInArrow(trimmed(run), types).toDF(*["ids" if c == column else c for c in docs.columns])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded text)."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [pieces(path).decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def _digest(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_ids", "ids_crc32", "decoded_chars", "decoded_sha256"]
        for b in batches:
            p, rows = pieces(path), []
            for k in range(b.num_rows):
                ids = b.column(1)[k].values.to_numpy(zero_copy_only=False)
                text = p.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text), hashlib.sha256(text.encode()).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=names)

    return run


def digests(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> counts and digests of the ids and of the text decoded from them."""
    return rows.select("doc_id", "ids").mapInArrow(_digest(path), "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return digests(encoded(rows, model_path()), model_path())
