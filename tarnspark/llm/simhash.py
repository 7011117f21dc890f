"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A fingerprint's 64 bits are cut into 32 segments of two; their bit counts form a vector whose Manhattan distance never
exceeds the Hamming distance. The 32 dimensions are dealt to g groups. Two vectors within distance 4 differ in at most
four groups, so they agree on g - 4: they share a unit cell of at least one of the grids over g - 4 groups, whatever g is. More
groups make longer keys but more grids, so g follows the number of fingerprints: 6 (15 grids) to 10 (210). Candidates of a
cell pass the Manhattan bound, then the exact Hamming distance. A pair is taken in the first grid its vectors share only,
and a cell passes on a spanning forest of its links, never all pairs. Cells beyond BLOCK members are cut into blocks that
meet pairwise in tasks of their own, so a hot cell neither sits in one task nor loses a pair.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other; texts of
fewer words than a shingle form one shingle; repeated rows link with each other; rows with a null doc_id take part and
their group's id is the smallest non-null doc_id (null if there is none). Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, doc_key, ranges, renamed, restored, stored, text_or_empty
from tarnspark.llm.components import components, forest

SHINGLE, SEED, REACH = 4, 42, 4
SEGMENTS = 32
#: Members of a cell that meet in one task.
BLOCK = 2048
#: Candidate pairs that one numpy step compares.
STEP_PAIRS = 1 << 18

_LOW = 0x5555555555555555
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


class Grids:
    """The segments dealt to groups as evenly as can be, and the grids over all but REACH of them."""

    def __init__(self, groups: int) -> None:
        cut = [round(k * SEGMENTS / groups) for k in range(groups + 1)]
        self.masks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in itertools.pairwise(cut)]
        self.over = list(itertools.combinations(range(groups), groups - REACH))


def groups_for(n: int) -> int:
    """Groups for n fingerprints: a key of g - 4 groups tells some 2**(48 (g - 4) / g) random vectors apart, and a cell
    should hold few of them."""
    return next((g for g in range(6, 10) if n <= 16 << 48 * (g - REACH) // g), 10)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash over XXH64 of word shingles; bytes.lower and bytes.split know ASCII only, as the definition asks."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    cut = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, cut, itertools.repeat(seed)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n = len(h)
    lanes = h.view(np.uint8).reshape(n, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.as_buffer() else b"") for t in b.column(1).cast(pa.binary())), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits) for every row."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts (0 to 2) of the 32 two-bit segments, packed in two bits each."""
    half = F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseXOR(half).bitwiseAND(F.lit(_LOW))).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW)), 1))


def _embedded(fp: np.ndarray) -> np.ndarray:
    low, half = np.uint64(_LOW), fp >> np.uint64(1)
    return ((fp ^ half) & low) | ((fp & half & low) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed segment counts; fields lie in 0..2, so |x - y| is the popcount of their unary codes' XOR."""
    low = np.uint64(_LOW)

    def unary(e: np.ndarray) -> np.ndarray:  # 0 -> 00, 1 -> 01, 2 -> 11
        two = (e >> np.uint64(1)) & low
        return (e & low) | two | (two << np.uint64(1))

    return np.bitwise_count(unary(a) ^ unary(b))


def _links(grids: Grids, grid: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) link and have the given grid as the first that they share."""
    e = _embedded(fp)
    near = np.flatnonzero(manhattan(e[i], e[j]) <= REACH)
    near = near[np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= REACH]
    differ = e[i[near]] ^ e[j[near]]
    same = np.stack([differ & np.uint64(m) == 0 for m in grids.masks], 1)
    rank = np.cumsum(same, 1) * same
    wanted = np.array(grids.over)[grid[i[near]]]
    first = np.ones(len(near), bool)
    for k in range(wanted.shape[1]):
        first &= rank[np.arange(len(near)), wanted[:, k]] == k + 1
    return near[first]


def _pairs(lo: int, left: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a cell at lo..lo+n: left is 0 (all within), or only the first left members meet the others."""
    rows, width = (np.arange(n - 1), None) if not left else (np.arange(left), n - left)
    per = max(1, STEP_PAIRS // max(1, n))
    for a in range(0, len(rows), per):
        r = rows[a : a + per]
        count = n - 1 - r if width is None else np.full(len(r), width)
        yield lo + np.repeat(r, count), lo + ranges(r + 1 if width is None else np.full(len(r), left), count)


def _cells(grids: Grids) -> Callable:
    """Rows (grid, cell, bi, bj, side, fp) sorted by all of them -> links (a, b). A cell's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)])
                kept = rows if kept is None else np.concatenate([kept, rows], 1)
            if kept is None or not kept.shape[1]:
                continue
            cut = np.flatnonzero((kept[:4, 1:] != kept[:4, :-1]).any(0)) + 1
            starts = np.append(0, cut)
            if b is not None:  # the last cell may go on in the next batch
                if not len(cut):
                    continue
                starts, rest = starts[:-1], kept[:, cut[-1] :]
                kept = kept[:, : cut[-1]]
            else:
                rest = None
            ends = np.append(starts[1:], kept.shape[1])
            grid, fp = kept[0], kept[5].view(np.uint64)
            size, apart = ends - starts, kept[2, starts] != kept[3, starts]
            found = []
            small = np.flatnonzero((size > 1) & (size <= 64) & ~apart)
            todo = size[small] * (size[small] - 1) // 2
            part = np.cumsum(todo) // STEP_PAIRS
            for p in np.unique(part):
                s = small[part == p]
                member = ranges(starts[s], size[s])
                after = np.repeat(ends[s], size[s]) - member - 1
                i, j = np.repeat(member, after), ranges(member + 1, after)
                ok = _links(grids, grid, fp, i, j)
                found.append((i[ok], j[ok]))
            for k in np.flatnonzero((size > 1) & ((size > 64) | apart)):
                left = int(np.count_nonzero(kept[4, starts[k] : ends[k]] == 0)) if apart[k] else 0
                if apart[k] and left in (0, size[k]):
                    continue
                own = []
                for i, j in _pairs(int(starts[k]), left, int(size[k])):
                    ok = _links(grids, grid, fp, i, j)
                    if len(ok):
                        f = forest(i[ok] - starts[k], j[ok] - starts[k], int(size[k]))
                        own.append((i[ok][f], j[ok][f]))
                if own:
                    i, j = (np.concatenate(x) for x in zip(*own, strict=True))
                    f = forest(i - starts[k], j - starts[k], int(size[k]))
                    found.append((i[f], j[f]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                f = forest(i, j, kept.shape[1])
                yield pa.record_batch([pa.array(fp[i[f]].view(np.int64)), pa.array(fp[j[f]].view(np.int64))], names=["a", "b"])
            kept = rest

    return run


def links(fps: DataFrame, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) whose components are those of all pairs within REACH bits."""
    e, grids = F.col("e"), Grids(groups or groups_for(fps.count()))
    masks = [_signed(sum(grids.masks[k] for k in over)) for over in grids.over]
    cells = fps.select("fp", embedding(F.col("fp")).alias("e")).select("fp", F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), e.bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(masks)])).alias("c")).select("c.grid", "c.cell", "fp")
    large = cells.groupBy("grid", "cell").count().filter(F.col("count") > block).select("grid", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = stored(large, "large-cells")  # a bare scan: Spark can split the join's large partitions
    dealt = (
        cells.join(large, ["grid", "cell"], "left")
        .withColumn("own", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select("grid", "cell", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    )
    key = ["grid", "cell", "bi", "bj"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "side", "fp").mapInArrow(_cells(grids), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fp = stored(fingerprints(docs), "fingerprints")
    first = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    root = components(links(first.select("fp")))
    named = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fp.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one of least doc_id (then text hash); columns as they were."""
    bounded_batches(docs.sparkSession)
    wide, own = renamed(docs)
    text = text_or_empty(own["text"])
    keyed = wide.withColumn("_d", doc_key(own["doc_id"]).cast("long")).withColumn("_tag", F.xxhash64(text))
    names = ["_d", "_tag", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py().encode()) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=names)

    fp = stored(keyed.select("_d", "_tag", text.alias("text")).mapInArrow(run, "_d long, _tag long, fp long"), "fingerprints")
    first = stored(fp.groupBy("fp").agg(F.min(F.struct("_d", "_tag")).alias("first")), "distinct")
    root = components(links(first.select("fp")))
    kept = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    once = F.row_number().over(Window.partitionBy("_d", "_tag").orderBy("_d"))
    return restored(keyed.join(kept, ["_d", "_tag"], "left_semi").withColumn("_n", once).filter("_n = 1"), own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _oracle() -> str:
    """XXH64, fingerprints and components by SQL alone, in 128-bit integers: products are taken modulo 2**64, rotations are
    products modulo 2**64 - 1. All pairs of fingerprints are compared: for small tables only."""
    # Fixed values of XXH64: its five primes.
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m, turn = f"{1 << 64}::UHUGEINT", f"{(1 << 64) - 1}::UHUGEINT"
    times = lambda x, p: f"(({x}) * {p} % {m})"
    rot = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {turn})"
    plus = lambda x, y: f"((({x}) + ({y})) % {m})"
    mix = lambda acc, lane: times(rot(plus(acc, times(lane, p2)), 31), p1)
    fold = lambda first, rest, step: f"list_reduce(list_prepend({first}, {rest}), lambda a, l: {step})"
    lane = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    start = [(SEED + 11400714785074694791 + 14029467366897019727) % (1 << 64), (SEED + 14029467366897019727) % (1 << 64), SEED, (SEED - 11400714785074694791) % (1 << 64)]
    stripes = ", ".join(f"{fold(f'{v}::UHUGEINT', f'list_transform(range(0, n // 32), lambda i: {lane(f"32 * i + {8 * k}", 8)})', mix('a', 'l'))} AS v{k}" for k, v in enumerate(start))
    joined = plus(plus(rot("v0", 1), rot("v1", 7)), plus(rot("v2", 12), rot("v3", 18)))
    for k in range(4):
        joined = plus(times(f"xor({joined}, {mix('0::UHUGEINT', f'v{k}')})", p1), p4)
    eights = fold("h", f"list_transform(range(0, (n % 32) // 8), lambda i: {lane('n // 32 * 32 + 8 * i', 8)})", plus(times(rot(f"xor(a, {mix('0::UHUGEINT', 'l')})", 27), p1), p4))
    four = plus(times(rot(f"xor(h, {times(lane('n // 8 * 8', 4), p1)})", 23), p2), p3)
    ones = fold("h", f"list_transform(range(0, n % 4), lambda i: {lane('n // 4 * 4 + i', 1)})", times(rot(f"xor(a, {times('l', p5)})", 11), p1))
    bits = ", ".join(f"sum((h >> {b}) & 1) AS s{b}" for b in range(64))
    fp = " + ".join(f"CASE WHEN 2 * s{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {SHINGLE} THEN [array_to_string(w, ' ')]
                         ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS s FROM t),
u AS (SELECT s, hex(encode(s)) AS x, strlen(s)::BIGINT AS n FROM (SELECT DISTINCT s FROM g)),
h1 AS (SELECT s, x, n, {stripes} FROM u),
h2 AS (SELECT s, x, n, {plus(f"CASE WHEN n >= 32 THEN {joined} ELSE {SEED}::UHUGEINT + {p5} END", "n::UHUGEINT")} AS h FROM h1),
h3 AS (SELECT s, x, n, {eights} AS h FROM h2),
h4 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM h3),
h5 AS (SELECT s, {ones} AS h FROM h4),
h6 AS (SELECT s, {times(f"xor(h, h // {1 << 33}::UHUGEINT)", p2)} AS h FROM h5),
h7 AS (SELECT s, {times(f"xor(h, h // {1 << 29}::UHUGEINT)", p3)} AS h FROM h6),
h8 AS (SELECT s, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM h7),
c AS (SELECT rid, count(*) AS n, {bits} FROM g JOIN h8 USING (s) GROUP BY rid),
f AS (SELECT t.rid, t.doc_id, coalesce(({fp})::UBIGINT, 0::UBIGINT) AS fp FROM t LEFT JOIN c USING (rid)),
o AS (SELECT fp, min(doc_id) AS first FROM f GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM o a, o b WHERE bit_count(xor(a.fp, b.fp)::HUGEINT) <= {REACH}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT r.a AS fp, min(o.first) AS component_id FROM r JOIN o ON o.fp = r.b GROUP BY r.a)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM f JOIN k USING (fp)
"""


ORACLE = _oracle()
