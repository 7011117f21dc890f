"""Near copies by SimHash of word shingles, completed by MinHash; the exact Jaccard similarity of the shingle sets decides.

First the SimHash operator's grids link fingerprints (here of the five-word shingles) that differ in at most REACH bits; texts
of a fingerprint meet the least of them, and the least of linked fingerprints meet. Pairs that pass the exact check are
links. Four of 64 bits miss most copies near a similarity of 0.8, so MinHash bands give the candidates that are left.

Texts of the same words fall together first. Each other text has BANDS keys of ROWS minima each; two texts of similarity s
share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.99995 at 0.8, more above. Members of a key form a bucket, and
buckets of the same members count once. First every member meets the least member of its bucket; then, in buckets that
this leaves in several components, all members of different components meet, in blocks. So a large group of copies costs
as many comparisons as it has members, and no pair that shares a key is left undecided.

Defined results: words are those of the SimHash operator (ASCII case and spaces); a null text counts as empty; texts
without words are copies of each other; texts of fewer words than a shingle form one shingle; sets, not multisets, are
compared. Extra columns pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, doc_key, mixed, renamed, restored, stored, text_or_empty, trimmed
from tarnspark.llm import simhash
from tarnspark.llm.components import components

SHINGLE, SEED = 5, 43
#: Least similarity of a pair, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 25, 5
#: Members of a bucket that meet in one task.
BLOCK = 512
#: Shingles that one numpy step hashes.
STEP_SHINGLES = 256

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(text: bytes) -> np.ndarray:
    """XXH64 of the text's word shingles, in order."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - SHINGLE + 1)
    cut = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[max(0, min(SHINGLE, len(words)) - 1) :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, itertools.repeat(SEED)), np.uint64, n)


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of a shingle set."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), STEP_SHINGLES):
        np.minimum(least, (low[a : a + STEP_SHINGLES] * _FACTORS + _TERMS).min(1), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(31) + column)
    return keys.view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_d, _tag, text) -> (_d, _tag, key of the words, bands, SimHash fingerprint)."""
    for b in batches:
        texts = [t.as_py().encode() for t in b.column(2)]
        keys = [_signed(xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED)) for t in texts]
        bands, fps = [], []
        for t in texts:
            h = shingles(t)
            bands.append(band_keys(h))
            fps.append(_signed(simhash.majority(h)))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["_d", "_tag", "key", "bands", "fp"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, own: ascending distinct shingles)."""
    for b in batches:
        own = [np.unique(shingles(t.as_py().encode())).view(np.int64) for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(own, pa.list_(pa.int64()))], names=["key", "own"])


def _near(shared: np.ndarray, n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return LEAST[1] * shared >= LEAST[0] * (n + m - shared)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) -> the near pairs (a, b)."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.asarray(s.values).view(np.int64) for s in (x, y))
            shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            ok.append(bool(_near(shared, len(x), len(y))))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, h, bi, bj, side, key, root, own) sorted by them -> near pairs (a, b) that join different roots. Where bi
    and bj differ, the members of side 0 meet those of side 1; the rows of a bucket follow each other."""
    held, at = [], None
    for b in itertools.chain(batches, [None]):
        rows = zip(*(b.column(k).to_pylist() for k in range(7)), b.column(7), strict=True) if b is not None else [(None,) * 8]
        for *place, side, key, root, own in rows:
            if place != at:
                if len(held) > 1:
                    pairs = _joined(held, at[2] != at[3])
                    if pairs:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])
                held, at = [], place
            if own is not None:
                held.append((side, key, root, np.asarray(own.values).view(np.int64)))


def _joined(held: list[tuple], apart: bool) -> list[tuple[int, int]]:
    side, key, root = (np.array([r[k] for r in held], np.int64) for k in range(3))
    size = np.array([len(r[3]) for r in held])
    word = np.unique(np.concatenate([r[3] for r in held]), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mine, out = np.zeros(word.max() + 1, np.int64), []
    for i in np.flatnonzero(side == 0) if apart else range(len(held) - 1):
        meets = (root != root[i]) & ((side == 1) if apart else (np.arange(len(held)) > i))
        if not meets.any():
            continue
        ids = word[start[i] : start[i] + size[i]]
        mine[ids] = 1
        shared = np.add.reduceat(mine[word], start)
        mine[ids] = 0
        for j in np.flatnonzero(meets & _near(shared, size, size[i])):
            if root[j] != root[i]:
                out.append((int(key[i]), int(key[j])))
                root[root == root[j]] = root[i]
    return out


def simhash_pairs(first: DataFrame) -> DataFrame:
    """(key, fp) -> candidates (a, b): keys of a fingerprint with the least of them, and the least of linked fingerprints."""
    least = stored(first.groupBy("fp").agg(F.min("key").alias("centre")), "fingerprints")
    same = first.join(least, "fp").filter("key <> centre").select(F.col("key").alias("a"), F.col("centre").alias("b"))
    linked = stored(simhash.links(least.select("fp")), "simhash")
    of = lambda name: least.select(F.col("fp").alias(name), F.col("centre").alias(f"{name}_key"))
    return stored(same.unionByName(linked.join(of("a"), "a").join(of("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))).distinct(), "candidates")


def links(first: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """first (key, _d, _tag, bands, fp) with distinct keys, texts (_d, _tag, text) -> (node, root) of near keys' components."""
    cells = first.select("key", F.posexplode("bands").alias("band", "h"))
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("y"), F.min("key").alias("centre")]
    buckets = cells.groupBy("band", "h").agg(*same).filter("n > 1").groupBy("n", "x", "y", "centre").agg(F.min(F.struct("band", "h")).alias("at")).select("at.*", "n", "centre")
    members = stored(cells.join(buckets, ["band", "h"]), "buckets")
    near = simhash_pairs(first.select("key", "fp"))
    asked = members.select("key").unionByName(near.select(F.col("a").alias("key"))).unionByName(near.select(F.col("b").alias("key"))).distinct()
    wanted = first.join(asked, "key", "left_semi").select("_d", "_tag", "key")
    sets = stored(texts.join(wanted, ["_d", "_tag"]).select("key", "text").mapInArrow(trimmed(_set_rows), "key long, own array<long>").groupBy("key").agg(F.first("own").alias("own")), "shingles")
    pairs = members.filter("key <> centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).unionByName(near).distinct()
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("y")), "b")
    near = stored(both.select("a", "b", "x", "y").mapInArrow(trimmed(_pair_rows), "a long, b long"), "links")
    root = stored(components(near), "roots")

    rooted = members.filter("n > 2").join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parted = rooted.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band", "h")
    parted = stored(rooted.join(parted, ["band", "h"]).select("band", "h", "n", "key", "root"), "parted")
    if parted.isEmpty():
        return root
    dealt = (
        parted.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own_block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "h", F.least("own_block", "other").alias("bi"), F.greatest("own_block", "other").alias("bj"), (F.col("own_block") > F.col("other")).cast("int").alias("side"), "key", "root")
    )
    place = ["band", "h", "bi", "bj"]
    more = dealt.join(sets, "key").select(*place, "side", "key", "root", "own").repartition(*place).sortWithinPartitions(*place, "side", "key").mapInArrow(trimmed(_bucket_rows), "a long, b long")
    return components(near.unionByName(more))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies, the one of least doc_id (then text hash); columns as they were."""
    bounded_batches(docs.sparkSession)
    wide, own = renamed(docs)
    text = text_or_empty(own["text"])
    keyed = wide.withColumn("_d", doc_key(own["doc_id"]).cast("long")).withColumn("_tag", F.xxhash64(text))
    texts = keyed.select("_d", "_tag", text.alias("text"))
    rows = texts.mapInArrow(trimmed(_key_rows), "_d long, _tag long, key long, bands array<long>, fp long")
    first = stored(rows.groupBy("key").agg(F.min(F.struct("_d", "_tag")).alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).select("key", "first.*", "bands", "fp"), "words")
    root = links(first, texts)
    kept = first.join(root.withColumnRenamed("node", "key"), "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("_d", "_tag")).alias("first")).select("first.*")
    once = F.row_number().over(Window.partitionBy("_d", "_tag").orderBy("_d"))
    return restored(keyed.join(kept, ["_d", "_tag"], "left_semi").withColumn("_n", once).filter("_n = 1"), own)
