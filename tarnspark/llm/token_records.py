"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

Record: uint64 length, uint32 masked checksum of those eight bytes, payload, uint32 masked checksum of the payload, all
little-endian; masking turns a CRC-32 by 15 bits and adds a constant, so that checksums of data holding checksums stay
sound. Payload: int64 doc_id, uint8 flags (1: doc_id is null, 2: ids are 16 bits wide), uint32 count, ids. A shard holds
one range of doc_id in ascending order; its index file is a magic, a count and one uint64 record offset a document.

Encoding uses the tokenizers library. Its pre-tokeniser always splits before a single space or newline between other
characters, so a text is the sequence of its words; each distinct word is encoded once, joined with others in one call,
and kept in a bounded per-process table. Texts with any other white space, or runs of it, and texts that hold one of the
vocabulary's added tokens (which the library takes as such), are encoded whole. Where the pre-tokeniser also splits a letter
from the mark that ends a word, such words share the encoding of the word without it.

A writer names its files by attempt and reports them in the manifest, so a retried or repeated task leaves an orphan but
never a damaged or doubled shard. Reading checks every length and checksum.

Defined results: a null text counts as empty: its record holds the end id alone; null doc_id sorts first; equal doc_id
are ordered by their texts' hashes; empty tables give no shard or shards without records. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, ranges, scratch, stored, text_or_empty
from tarnspark.llm.word_table import WordTable, cut

END_ID = 2
#: Words that a process keeps with their ids; others are encoded once a step.
KEPT_WORDS = 800_000
#: Characters of text and of joined new words in one step and one call.
STEP_CHARS, CALL_CHARS = 4 << 20, 1 << 15
INDEX_MAGIC = b"TRIX0001"

_HEAD, _BODY = struct.Struct("<QI"), struct.Struct("<qBI")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUNS = ("  ", " \n", "\n ", "\n\n")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token[0] in "ĠĊ"  # the byte-level forms of space and newline
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.marks = {m: ids[0] for m in ".,;:!?" if len(split(f" ab{m}")) == 2 and len(ids := self.whole([m], True)[0]) == 1}
        self.table = WordTable(self._new, kept_words)

    def by_words(self, text: str) -> bool:
        """Whether the text is the sequence of its words: single spaces and newlines between them, no added token."""
        return not (not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _RUNS)) or any(map(text.__contains__, self.added)) or _OTHER_SPACE.search(text))

    def whole(self, texts: list[str], words: bool = False) -> list[np.ndarray]:
        """Ids of texts, or of joined words, among which there is no added token."""
        self.tokenizer.encode_special_tokens = words
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (each opened by its newline or else a space), flat, and their lengths."""
        marked = np.array([len(w) > 1 and w[-1] in self.marks and w[-2].isalpha() for w in words], bool)
        bare: dict[str, int] = defaultdict(itertools.count().__next__)
        at = np.fromiter((bare[w[:-1] if m else w] for w, m in zip(words, marked.tolist(), strict=True)), np.int64, len(words))
        table, every = self.table, list(bare)
        place = np.fromiter(map(table.known.get, every, itertools.repeat(-1)), np.int64, len(every))
        fresh = np.flatnonzero(place < 0)
        flat, sizes = self._encoded([every[k] for k in fresh.tolist()])
        length, start = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        length[fresh], start[fresh] = sizes, table.used + np.cumsum(sizes) - sizes
        length[place >= 0], start[place >= 0] = table.length[place[place >= 0]], table.start[place[place >= 0]]
        total = length[at] + marked
        out, last = np.empty(int(total.sum()), np.uint32), np.cumsum(total)[marked] - 1
        body = np.ones(len(out), bool)
        body[last] = False
        out[last] = [self.marks[words[k][-1]] for k in np.flatnonzero(marked).tolist()]
        out[body] = np.concatenate([table.ids[: table.used], flat])[ranges(start[at], length[at])]
        return out, total

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library, many words joined in a call."""
        opened = [w if w[0] == "\n" else " " + w for w in words]
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        sizes = np.cumsum([len(w) for w in opened])
        for a, b in cut(sizes, CALL_CHARS):
            ids = self.whole(["".join(opened[a:b])], True)[0]
            at = np.flatnonzero(self.opens[ids])
            if len(at) != b - a:  # a word that the pre-tokeniser opens otherwise: ask for each by itself
                each = self.whole(opened[a:b], True)
                ids, at = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            flat.append(ids)
            lengths.append(np.diff(np.append(at, len(ids))))
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, texts: list[str], end: int = END_ID) -> list[np.ndarray]:
        """Ids of each text, followed by the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.by_words(t)]
        rest = sorted(set(range(len(texts))) - set(plain))
        for k, ids in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
            out[k] = np.append(ids, np.uint32(end))
        sizes = np.cumsum([len(texts[k]) for k in plain])
        for a, b in cut(sizes, STEP_CHARS):
            split = [("\n" + texts[k]).replace("\n", " \n").split(" ") for k in plain[a:b]]  # the first piece is empty
            counts = np.array([len(s) - 1 for s in split])
            ids, n = self.table.encode([w for s in split for w in s[1:]], counts)
            ends = np.cumsum(n)
            ids = np.append(ids[1:], 0)  # drops the newline put before each text, which makes room for the end id
            ids[ends - 1] = end
            for k, x in zip(plain[a:b], np.split(ids, ends[:-1]), strict=True):
                out[k] = x
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def payload(doc_id: int | None, ids: np.ndarray, narrow: bool) -> bytes:
    return _BODY.pack(doc_id or 0, (doc_id is None) | narrow << 1, len(ids)) + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpacked(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, n = _BODY.unpack_from(data)
    ids = np.frombuffer(data, "<u2" if flags & 2 else "<u4", offset=_BODY.size)
    if len(ids) != n:
        raise ValueError("a record's count does not match its length")
    return None if flags & 1 else doc_id, ids


def _records(stream) -> Iterator[bytes]:
    """Payloads of a shard, checked, read in order."""
    while head := stream.read(_HEAD.size):
        size, crc = _HEAD.unpack(head)
        if masked(head[:8]) != crc:
            raise ValueError("a record's length is damaged")
        body = stream.read(size + 4)
        if len(body) != size + 4 or masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a record is damaged")
        yield body[:-4]


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path as Hadoop writes it, and the path in it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def read_one(path: str, index: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a shard through its index: a random read of two places."""
    fs, p = filesystem(index)
    with fs.open_input_file(p) as f:
        head = f.read_at(16, 0)
        if head[:8] != INDEX_MAGIC or not 0 <= k < struct.unpack("<Q", head[8:])[0]:
            raise IndexError(k)
        at = struct.unpack("<Q", f.read_at(8, 16 + 8 * k))[0]
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        f.seek(at)
        return unpacked(next(_records(f)))


_MANIFEST = "shard int, path string, index string, records long, tokens long, bytes long"


def write_records(docs: DataFrame, folder: str, vocabulary: str, end: int = END_ID) -> DataFrame:
    """Encodes doc_id, text and writes shards under folder; returns the manifest, one row a shard in doc_id order."""
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        fs, p = filesystem(folder)
        fs.create_dir(p, recursive=True)
        name_at = f"{p}/{name.rsplit('/', 1)[1]}"
        enc, at, tokens, offsets = encoder(vocabulary), 0, 0, []
        with fs.open_output_stream(name_at + ".rec") as out:
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist(), end), strict=True):
                    record = framed(payload(doc_id, ids, enc.narrow))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(ids)
        with fs.open_output_stream(name_at + ".idx") as out:
            out.write(INDEX_MAGIC + struct.pack("<Q", len(offsets)) + np.array(offsets, "<u8").tobytes())
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name + ".rec"]), pa.array([name + ".idx"]), *(pa.array([x], pa.int64()) for x in (len(offsets), tokens, at))], names=["shard", "path", "index", "records", "tokens", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(write, _MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, p = filesystem(path)
            rows = []
            with fs.open_input_stream(p, buffer_size=1 << 20) as stream:
                for doc_id, ids in map(unpacked, _records(stream)):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the shards. The running start needs one row a
    shard only."""
    start = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", start.alias("start"))
    n = max(1, min(manifest.count(), 100_000))
    return placed.repartitionByRange(n, "shard").select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_records(write_records(docs, scratch(spark, "records"), tokenizer_path()))
