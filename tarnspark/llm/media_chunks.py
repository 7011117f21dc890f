"""Media columns in a content-addressed chunk store.

A payload (a text's UTF-8 bytes, padded) becomes a WAV file of 8-bit mono samples. A rolling gear hash cuts the file at
content-defined places; each chunk has a 128-bit digest. Digests that occur more than once are found by a grouped count,
and each of their chunks is stored once, in a table keyed by digest; chunks that occur once stay together in their
document's pack, so they never move through a shuffle. A file is read back by joining its ordered chunk list with the
chunk table, and its hash must equal the one recorded when it was cut.

Writers learn which digests are shared from a Bloom filter of constant size. A false positive only sends a lone chunk to the
chunk table; as tables grow past what the filter tells apart, more chunks go that way and results stay the same.

Defined results: a null text is an empty payload (64 zero bytes); equal texts have equal values; repeated rows, and rows
with null or equal doc_id, are stored and returned one by one; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, mixed, stored, text_or_empty
from tarnspark.llm.quality_rules import _crc_step

UNIT, RATE, HEADER = 64, 8000, 44
#: Chunk sizes in bytes: least, most, and the bits of the hash that must be zero at a cut (mean distance 2**bits).
LEAST, MOST, CUT_BITS = 256, 8192, 10
#: Bits of the Bloom filter over shared digests (8 MiB), and of its hash functions.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 4
#: Bytes of one Arrow batch that a writer yields.
OUT_BYTES = 4 << 20

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def wav(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n & 0xFFFFFFFF) + payload


def samples(media: bytes) -> bytes:
    """The payload of a WAV file made by wav()."""
    head = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (head[0], head[2], head[5], head[6], head[10], head[11]) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or head[12] != len(media) - HEADER & 0xFFFFFFFF:
        raise ValueError("not an 8-bit mono WAV file, or cut short")
    return media[HEADER:]


def cuts(media: bytes) -> list[int]:
    """Ends of the content-defined chunks of media."""
    h, k = _GEAR[np.frombuffer(media, np.uint8)], 1
    while k < 32:  # h = (h << 1) + gear, unrolled by doubling: 32 bits see the last 32 bytes
        h[k:] += h[:-k] << np.uint32(k)
        k *= 2
    at = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, start, n = [], 0, len(media)
    for p in [*at, n]:
        while p - start > MOST:
            start += MOST
            ends.append(start)
        if p - start >= LEAST or (p == n and p > start):
            ends.append(p)
            start = p
    return ends


def chunks(media: bytes) -> tuple[list[bytes], np.ndarray]:
    """Chunks in order, and their digests as an (n, 2) array of int64."""
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return parts, np.frombuffer(b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in parts), np.int64).reshape(-1, 2)


def _media(text: pa.Scalar) -> tuple[int, bytes]:
    data = text.as_py().encode()
    return len(data), wav(payload_of(data))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.concatenate([np.zeros((0, 2), np.int64), *(chunks(_media(t)[1])[1] for t in b.column(0))])
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["hi", "lo"])


def _bloom_places(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    a, b = hi.view(np.uint64), lo.view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(BLOOM_BITS) for k in range(BLOOM_HASHES)])


def _bloom_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        place = np.unique(_bloom_places(np.ascontiguousarray(b.column(0).to_numpy()), np.ascontiguousarray(b.column(1).to_numpy())).ravel())
        yield pa.record_batch([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["word", "bits"])


def shared_filter(shared: DataFrame) -> np.ndarray:
    """Bloom filter of shared (hi, lo): at most BLOOM_BITS / 64 rows come to the driver, whatever the table's size."""
    words = shared.mapInArrow(_bloom_rows, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe_shared(bloom: np.ndarray, digests: np.ndarray) -> np.ndarray:
    place = _bloom_places(np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1]))
    return (bloom[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).all(0)


_PACK = "doc_id long, n_bytes long, media_sha256 string, list array<struct<hi:long,lo:long,size:int,shared:boolean>>, pack binary"
_LIST_TYPE = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("size", pa.int32()), ("shared", pa.bool_())]))


def _pack_rows(bloom) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t in b.column(1):
                n, media = _media(t)
                parts, digests = chunks(media)
                shared = _maybe_shared(bloom.value, digests).tolist()
                cols[0].append(n)
                cols[1].append(hashlib.sha256(media).hexdigest())
                cols[2].append([{"hi": h, "lo": lo, "size": len(c), "shared": s} for (h, lo), c, s in zip(digests.tolist(), parts, shared, strict=True)])
                cols[3].append(squeeze.compress(b"".join(c for c, s in zip(parts, shared, strict=True) if not s)))
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], _LIST_TYPE), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "media_sha256", "list", "pack"])

    return run


def _shared_rows(bloom) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for b in batches:
            once: dict[tuple[int, int], bytes] = {}
            for t in b.column(0):
                parts, digests = chunks(_media(t)[1])
                keep = np.flatnonzero(_maybe_shared(bloom.value, digests)).tolist()
                once |= {tuple(digests[k].tolist()): parts[k] for k in keep}
            keys = np.array(list(once), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([squeeze.compress(c) for c in once.values()], pa.binary())], names=["hi", "lo", "body"])

    return run


def write_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text -> (packs, chunk table). packs: one row a document with its ordered chunk list; chunk table: one row
    (hi, lo, body) for each digest that may be shared."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shared = rows.select("text").mapInArrow(_digest_rows, "hi long, lo long").groupBy("hi", "lo").count().filter("count > 1").select("hi", "lo")
    bloom = spark.sparkContext.broadcast(shared_filter(shared))
    packs = stored(rows.mapInArrow(_pack_rows(bloom), _PACK).withColumn("row", F.monotonically_increasing_id()), "packs")
    table = stored(rows.select("text").mapInArrow(_shared_rows(bloom), "hi long, lo long, body binary").groupBy("hi", "lo").agg(F.first("body").alias("body")), "chunks")
    return packs, table


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, media_sha256, list, pack, got) -> (doc_id, n_bytes, media), verified."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out, size, begun = [], 0, 0
        for k in range(b.num_rows):
            pack, at, parts = unpack.decompress(b.column(4)[k].as_py()), 0, []
            got = {g["ord"]: g["body"] for g in b.column(5)[k].as_py() or ()}
            for i, c in enumerate(b.column(3)[k].as_py()):
                if c["shared"]:
                    if i not in got:
                        raise ValueError("a chunk that a document shares is not in the chunk table")
                    parts.append(unpack.decompress(got[i]))
                else:
                    parts.append(pack[at : at + c["size"]])
                    at += c["size"]
            media = b"".join(parts)
            if hashlib.sha256(media).hexdigest() != b.column(2)[k].as_py():
                raise ValueError("a stored file does not have the hash it was stored with")
            out.append(media)
            size += len(media)
            if size >= OUT_BYTES or k == b.num_rows - 1:
                yield pa.record_batch([b.column(0).slice(begun, len(out)), b.column(1).slice(begun, len(out)), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "media"])
                out, size, begun = [], 0, k + 1


def read_store(packs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) of every stored document, verified; a missing chunk is an error. Documents of lone
    chunks are read where they lie; only lists with shared chunks meet the chunk table."""
    bounded_batches(packs.sparkSession)
    some = F.exists("list", lambda c: c["shared"])
    schema, columns = "doc_id long, n_bytes long, media binary", ["doc_id", "n_bytes", "media_sha256", "list", "pack"]
    alone = packs.filter(~some).select(*columns, F.lit(None).cast("array<struct<ord:int,body:binary>>").alias("got")).mapInArrow(_rebuild, schema)
    refs = packs.filter(some).select("row", F.posexplode("list").alias("ord", "c")).filter("c.shared").select("row", "ord", "c.hi", "c.lo")
    got = refs.join(table, ["hi", "lo"]).groupBy("row").agg(F.collect_list(F.struct("ord", "body")).alias("got"))
    joined = packs.filter(some).join(got, "row", "left").select(*columns, "got").mapInArrow(_rebuild, schema)
    return alone.unionByName(joined)


def feature(payload: bytes) -> str:
    """Sum, least and greatest sample, sign changes about the middle, and energy, in integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={int(x.sum())};min={int(x.min())};max={int(x.max())};turns={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};energy={int((x * x).sum())}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for m in b.column(2):
            media = m.as_py()
            p = samples(media)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(*write_store(docs)).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _oracle() -> str:
    """The contract's columns from the texts, by SQL alone; CRC-32 is unrolled over the tail's bytes."""
    little = lambda x: f"format('{{:02x}}{{:02x}}{{:02x}}{{:02x}}', ({x}) & 255, (({x}) >> 8) & 255, (({x}) >> 16) & 255, (({x}) >> 24) & 255)"
    head = wav(b"").hex()  # of an empty file: the two sizes are put in
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT *, (length(h) // 2)::BIGINT AS n, greatest({UNIT}, (length(h) // 2 + {UNIT - 1}) // {UNIT} * {UNIT})::BIGINT AS size FROM d),
p AS (SELECT rid, doc_id, n, size, h || repeat('0', 2 * (size - n)) AS p FROM t),
v AS (SELECT rid, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT rid, regexp_extract_all(p, '..') AS l FROM p)),
x AS (SELECT rid, i, ('0x' || b)::BIGINT - 128 AS x FROM v),
y AS (SELECT *, lag(x) OVER (PARTITION BY rid ORDER BY i) AS back FROM x),
f AS (SELECT rid, 'sum=' || sum(x)::BIGINT || ';min=' || min(x) || ';max=' || max(x) || ';turns=' || count(*) FILTER ((x < 0) <> (back < 0)) || ';energy=' || sum(x * x)::BIGINT AS feature FROM y GROUP BY rid),
z AS (SELECT i::BIGINT AS i, {_crc_step()} AS c FROM range(256) r(i)),
q AS (SELECT list(c ORDER BY i) AS tab FROM z)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(right(p, {2 * UNIT}), '..'), lambda s: ('0x' || s)::BIGINT)),
           lambda a, s: xor(tab[(xor(a, s) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS tail_crc32,
       size + {HEADER} AS media_bytes, sha256(unhex('{head[:8]}' || {little("36 + size")} || '{head[16:80]}' || {little("size")} || p)) AS media_sha256, feature
FROM p JOIN f USING (rid), q
"""


ORACLE = _oracle()
