"""Repeated-passage removal: a depth-limited radix sort of suffixes whose equal groups are the repeated windows.

Wanted: everything covered by a window of `depth` units that starts at two or more places (the same document included). Units
are bytes (BYTES: 400 of them) or words (WORDS: 50 of them, whatever white space lies between). Sorting every suffix would
move each unit many times, so suffixes are ordered most significant digit first and a pass keeps only what can still repeat:

1. First digit: `digit` units. Windows are entered at their minimiser, the string of `digit` units of least hash among the
   depth - digit + 1 in the window (the leftmost of equals). Equal windows have equal minimisers at equal places, so a window
   whose minimiser's digit occurs once is unique, and only some 2 in 338 suffixes take part, each for a range of windows.
   Strings that begin with a run of short period are chosen last: a run of one word would tie at every repetition.
2. Longest digit: the union of an anchor's own windows, by 128-bit hash. Equal unions make each of these windows a repeat;
   one representative goes on, so exact copies and the insides of runs collapse here.
3. Remaining digits: within a group of equal anchors all members are aligned, so the windows at each shift are radix
   sorted by their hash: equal neighbours are repeats. All windows of an anchor overlap there, so what a member loses is
   one span, from its first to its last repeated window; these two are compared unit by unit, and a group in which
   hashes misled is sorted by the units themselves.

Groups beyond BLOCK members are not sorted in one task: their windows are counted by Spark by 128-bit hash, partially
aggregated before the shuffle, and joined back. Nothing is capped. Keys that many anchors share meet stored tables only, in
joins whose large partitions Spark splits. Words are known by 64-bit hashes.

Defined results: a null text counts as empty and loses nothing; texts shorter than a window lose nothing; repeated rows
repeat each other; documents are known by 128 bits of their doc_id and text, so rows with null or equal doc_id are told
apart by their texts, and rows alike in both lose the same. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import STEP_BYTES, bounded_batches, doc_key, forget, mixed, ranges, renamed, restored, scratch, steps, stored, text_or_empty, text_views

#: Members of an anchor group that one task sorts.
BLOCK = 16384
#: Members of small groups that are sorted in one numpy step, and shifts of a large one.
STEP_MEMBERS, STEP_SHIFTS = 1024, 32

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (split at ASCII white space) of texts."""
    solid = np.ones(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    solid[-1] = False
    opens, closes = solid[:-1].copy(), solid[:-1].copy()
    opens[1:] &= ~solid[:-2]
    closes &= ~solid[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a text's edge ends a word
    opens[cuts] = solid[cuts]
    closes[cuts - 1] = solid[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


@dataclass(frozen=True)
class Window:
    """What repeats: depth units, entered by strings of digit units (a power of two)."""

    depth: int
    digit: int
    words: bool = False

    @property
    def reach(self) -> int:
        return self.depth - self.digit

    @property
    def kind(self) -> type:
        return np.uint64 if self.words else np.uint8

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of texts, and the offsets of each text among them."""
        if not self.words:
            return data, offsets
        starts, ends = word_bounds(data, offsets)
        raw, found = data.tobytes(), []
        for a in range(0, len(starts), 1 << 16):
            cut = map(raw.__getitem__, map(slice, starts[a : a + (1 << 16)].tolist(), ends[a : a + (1 << 16)].tolist()))
            found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64))
        return np.concatenate([np.zeros(0, np.uint64), *found]), np.searchsorted(starts, offsets)

    def values(self, units: np.ndarray) -> np.ndarray:
        return units if self.words else _BYTE[units]

    def places(self) -> np.ndarray:
        """Odd factors, two sets, one for each place of an aligned context."""
        n = self.reach + self.depth
        return (mixed(np.arange(1001, 1001 + 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).reshape(2, n)


BYTES, WORDS = Window(400, 64), Window(50, 8, words=True)
DEPTH = BYTES.depth


def _rolled(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of width units (a power of two), by doubling; which begin with a run of short period."""
    h, k, base, half = values, 1, 0x9E3779B97F4A7C15 | 1, None
    while k < width:
        if 2 * k == width:
            half = (h >> np.uint64(32)).astype(np.uint32)
        h = h[:-k] * np.uint64(pow(base, k, 1 << 64)) + h[k:]
        k *= 2
    n = len(h)
    runs = np.zeros(n, bool)
    for period in range(1, width // 2 + 1):
        runs |= half[:n] == half[period : period + n]
    return mixed(h), runs


def _sliding(x: np.ndarray, width: int, op: np.ufunc, pad: int) -> np.ndarray:
    """op over each run of width values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, pad, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(w: Window, units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers of the windows that lie within one text: places, digits' hashes, and the first and last window start of
    each. Every window has one minimiser (the leftmost of equals), so the ranges of starts share no window. Long texts are
    worked on in parts that share depth - 1 units, so that each window lies in one part."""
    if len(offsets) == 2 and len(units) > 2 * STEP_BYTES:
        parts = []
        for a in range(0, len(units) - w.depth + 1, STEP_BYTES):
            part = units[a : a + STEP_BYTES + w.depth - 1]
            at, key, first, last = anchors(w, part, np.array([0, len(part)]))
            parts.append((at + a, key, first + a, last + a))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    if len(units) < w.depth:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h, runs = _rolled(w.values(units), w.digit)
    value = h >> np.uint64(33) << np.uint64(32) | runs.astype(np.uint64) << np.uint64(63) | np.arange(len(h), dtype=np.uint64)
    best = (_sliding(value, w.reach + 1, np.minimum, 0xFFFFFFFFFFFFFFFF) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(best) + 1, np.int32)
    long = offsets[1:] - offsets[:-1] >= w.depth
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, np.minimum(offsets[1:][long] - w.depth + 1, len(best)), -1)
    best[np.cumsum(inside[:-1]) == 0] = -1
    first = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    last = np.append(first[1:], len(best)) - 1
    used = best[first] >= 0
    at = best[first[used]]
    return at, h[at], first[used], last[used]


def _anchor_rows(w: Window) -> Callable:
    """(d1, d2, text) -> the anchors of each text, with the 128-bit hash of the union of an anchor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(w.kind).itemsize
        for b in batches:
            data, offsets = text_views(b.column(2))
            d1, d2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in steps(offsets):
                units, own = w.units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at, key, first, last = anchors(w, units, own)
                doc = np.searchsorted(own, at, "right") - 1
                raw = units.tobytes()
                unions = map(raw.__getitem__, map(slice, (first * size).tolist(), ((last + w.depth) * size).tolist()))
                wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, unions)), np.int64).reshape(-1, 2)
                shifts = (at - first) << 16 | (at - last)
                yield pa.record_batch([pa.array(c) for c in (key.view(np.int64), wide[:, 0], wide[:, 1], d1[lo + doc], d2[lo + doc], (at - own[doc]).astype(np.int32), shifts.astype(np.int32))], names=["key", "ha", "hb", "d1", "d2", "off", "shifts"])

    return run


def _context_rows(w: Window) -> Callable:
    """(d1, d2, text, places [(off, key, shifts)]) -> (key, d1, d2, off, left, context) of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(w.kind).itemsize
        for b in batches:
            data, offsets = text_views(b.column(2))
            d1, d2, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy()).cumsum()
            off, key, shifts = (flat.field(k).to_numpy() for k in range(3))
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.append(0, ends)))
            for one, two in steps(offsets):
                units, own = w.units(data[offsets[one] : offsets[two]], offsets[one : two + 1] - offsets[one])
                for lo in range(ends[one - 1] if one else 0, ends[two - 1], 4096):
                    part = slice(lo, min(lo + 4096, ends[two - 1]))
                    o, r, left = off[part].astype(np.int64), doc[part], shifts[part] >> 16
                    size = left - (shifts[part] & 0xFFFF) + w.depth
                    body = units[ranges(own[r - one] + o - left, size.astype(np.int64))]
                    binary = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((np.append(0, np.cumsum(size)) * width).astype(np.int32)), pa.py_buffer(body)])
                    yield pa.record_batch([*(pa.array(c) for c in (key[part], d1[r], d2[r], off[part], left.astype(np.int32))), binary], names=["key", "d1", "d2", "off", "left", "context"])

    return run


class _Members:
    """Aligned contexts of anchors: prefix sums along each row give the hash of the window at any shift (the number of units
    that it begins before the anchor)."""

    def __init__(self, w: Window, group: np.ndarray, left: np.ndarray, contexts: pa.Array, sets: int = 1) -> None:
        data, offsets = text_views(contexts)
        data, size = data.copy().view(w.kind), np.diff(offsets) // np.dtype(w.kind).itemsize
        span = w.reach + w.depth
        self.w, self.group = w, group
        self.grid = np.zeros((len(size), span), w.kind)
        self.grid.ravel()[ranges(np.arange(len(size)) * span + w.reach - left, size)] = data
        self.sums = np.zeros((sets, len(size), span + 1), np.uint64)
        for k, factors in enumerate(w.places()[:sets]):
            np.cumsum(w.values(self.grid) * factors, axis=1, out=self.sums[k, :, 1:])
        self.salt = mixed(group.view(np.uint64).copy())
        self.most, self.least = left, w.depth - (size - left)  # shifts of the anchor's own windows

    def window(self, a: int, b: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that start a, ..., b - 1 units before the anchor, a row a shift; which exist."""
        shift, span = np.arange(a, b), self.w.reach + self.w.depth
        h = (self.sums[k][:, span - shift] - self.sums[k][:, self.w.reach - shift]).T + self.salt
        return h, (shift[:, None] <= self.most) & (shift[:, None] >= self.least)

    def _bodies(self, rows: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return self.grid[rows[:, None], self.w.reach - shift[:, None] + np.arange(self.w.depth)]

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last shift at which a member's window equals that of another in its group; (0, -1): none."""
        n = len(self.salt)
        first, last, one, other = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        lone = mixed(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))
        for a in range(0, self.w.reach + 1, STEP_SHIFTS):
            h, ok = self.window(a, b := min(a + STEP_SHIFTS, self.w.reach + 1))
            h = np.where(ok, h, lone)
            order = np.argsort(h, axis=1)
            ordered = np.take_along_axis(h, order, 1)
            same = ordered[:, 1:] == ordered[:, :-1]
            beside = np.full(h.shape, -1)  # an equal neighbour in the order
            beside[:, :-1] = np.where(same, order[:, 1:], -1)
            beside[:, 1:] = np.where(same, order[:, :-1], beside[:, 1:])
            partner = np.empty_like(beside)
            np.put_along_axis(partner, order, beside, 1)
            found = (partner >= 0) & ok
            some = found.any(0)
            fresh = np.flatnonzero(some & (last < 0))
            first[fresh] = a + found[:, fresh].argmax(0)
            one[fresh] = partner[first[fresh] - a, fresh]
            some = np.flatnonzero(some)
            last[some] = b - 1 - found[::-1][:, some].argmax(0)
            other[some] = partner[last[some] - a, some]
        hit = np.flatnonzero(last >= 0)
        for shift, beside in ((first, one), (last, other)):
            mate = beside[hit]
            if (self._bodies(hit, shift[hit]) != self._bodies(mate, shift[hit])).any() or (self.group[hit] != self.group[mate]).any():
                return self.compared()
        return first, last

    def compared(self) -> tuple[np.ndarray, np.ndarray]:
        """As repeated, by the units themselves."""
        n = len(self.salt)
        first, last = np.zeros(n, np.int64), np.full(n, -1)
        for a in range(self.w.reach + 1):
            rows = np.flatnonzero((a <= self.most) & (a >= self.least))
            seen: dict[tuple, list[int]] = {}
            for r, body in zip(rows.tolist(), self._bodies(rows, np.full(len(rows), a)), strict=True):
                seen.setdefault((int(self.group[r]), body.tobytes()), []).append(r)
            for r in itertools.chain.from_iterable(x for x in seen.values() if len(x) > 1):
                first[r], last[r] = (first[r] if last[r] >= 0 else a), a
        return first, last


_SPAN_NAMES = ["d1", "d2", "off", "first", "last"]


def _sorted_groups(w: Window) -> Callable:
    """Rows sorted by key -> (d1, d2, off, first, last) of members with repeated windows."""

    def ready(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = t.column(0).to_numpy()
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        lo = 0
        while lo < len(cut) - 1:
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + STEP_MEMBERS, "right")) - 1)
            part = t.slice(cut[lo], cut[hi] - cut[lo])
            first, last = _Members(w, part.column(0).to_numpy(), part.column(4).to_numpy().astype(np.int64), part.column(5)).repeated()
            some = np.flatnonzero(last >= 0)
            yield pa.record_batch([*(part.column(k).take(pa.array(some)) for k in (1, 2, 3)), pa.array(first[some]), pa.array(last[some])], names=_SPAN_NAMES)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                kept.append(b)
                rows += b.num_rows
            if not kept or (b is not None and rows < 4 * STEP_MEMBERS):
                continue
            t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            key = t.column(0).to_numpy()
            end = t.num_rows if b is None else int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if end:
                yield from ready(t.slice(0, end))
            kept, rows = ([t.slice(end)] if end < t.num_rows else []), t.num_rows - end

    return run


def _window_rows(w: Window) -> Callable:
    """All windows through the anchors of a large group, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                m = _Members(w, part.column(0).to_numpy(), part.column(4).to_numpy().astype(np.int64), part.column(5), 2)
                (h, ok), (h2, _) = m.window(0, w.reach + 1), m.window(0, w.reach + 1, 1)
                shift, member = np.nonzero(ok)
                take = pa.array(member)
                yield pa.record_batch([part.column(0).take(take), pa.array(shift.astype(np.int64)), pa.array(h[shift, member].view(np.int64)), pa.array(h2[shift, member].view(np.int64)), *(part.column(k).take(take) for k in (1, 2, 3))], names=["key", "shift", "h", "h2", "d1", "d2", "off"])

    return run


def _identity(doc_id: str = "doc_id", text: str = "text") -> dict[str, F.Column]:
    """128 bits of a row's doc_id and text: two hashes of different seeds."""
    body = text_or_empty(text)
    return {"d1": F.xxhash64(body), "d2": F.xxhash64(F.lit(7), doc_key(doc_id).cast("long"), body)}


def repeated_spans(docs: DataFrame, window: Window = BYTES, block: int = BLOCK) -> DataFrame:
    """(d1, d2, spans array<struct<lo int, hi int>>): ranges of units through repeated windows, unmerged, of documents that
    have any."""
    spark, w = docs.sparkSession, window
    bounded_batches(spark)
    texts = docs.withColumns(_identity()).select("d1", "d2", "text")
    least = 2 * w.depth - 1 if w.words else w.depth  # bytes of the shortest text that holds a window
    found_at = scratch(spark, "anchors")
    found = stored(texts.filter(F.octet_length("text") >= least).mapInArrow(_anchor_rows(w), "key long, ha long, hb long, d1 long, d2 long, off int, shifts int"), found_at)
    twice = stored(found.groupBy("key").count().filter("count > 1").select("key"), "keys")
    places_at = scratch(spark, "shared")
    places = stored(found.join(twice, "key"), places_at)
    forget(spark, found_at)
    whole, place = ["key", "ha", "hb", "shifts"], F.struct("d1", "d2", "off")
    copies = stored(places.groupBy(*whole).agg(F.count("*").alias("n"), F.min(place).alias("one")).filter("n > 1").drop("n"), "unions")
    places = stored(places.join(copies, whole, "left").select("key", "d1", "d2", "off", "shifts", "one"), "places")
    forget(spark, places_at)
    open_places = places.filter(F.col("one").isNull() | (F.col("one") == place)).drop("one")
    sizes = stored(open_places.groupBy("key").count().filter("count > 1").select("key", (F.col("count") > block).alias("large")), "groups")
    lists = open_places.join(sizes, "key").groupBy("d1", "d2").agg(F.collect_set(F.struct("off", "key", "shifts")).alias("places"))
    contexts = texts.join(lists, ["d1", "d2"]).select("d1", "d2", "text", "places").mapInArrow(_context_rows(w), "key long, d1 long, d2 long, off int, left int, context binary")
    large = sizes.filter("large").select("key")
    from_large = None
    if not large.isEmpty():
        contexts = stored(contexts, "contexts")
        windows = contexts.join(large, "key", "left_semi").mapInArrow(_window_rows(w), "key long, shift long, h long, h2 long, d1 long, d2 long, off int")
        same = ["key", "shift", "h", "h2"]
        again = stored(windows.groupBy(*same).count().filter("count > 1").drop("count"), "windows")
        from_large = windows.join(again, same).groupBy("d1", "d2", "off").agg(F.min("shift").alias("first"), F.max("shift").alias("last"))
        contexts = contexts.join(large, "key", "left_anti")
    spans = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(w), "d1 long, d2 long, off int, first long, last long")
    if from_large is not None:
        spans = spans.unionByName(from_large)
    spans = spans.unionByName(places.filter("one is not null").select("d1", "d2", "off", F.col("shifts").bitwiseAND(F.lit(0xFFFF)).cast("long").alias("first"), F.shiftright("shifts", 16).cast("long").alias("last")))
    span = F.struct((F.col("off") - F.col("last")).cast("int").alias("lo"), (F.col("off") - F.col("first") + w.depth).cast("int").alias("hi"))
    return spans.groupBy("d1", "d2").agg(F.collect_set(span).alias("spans"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    order = np.argsort(lo, kind="stable")
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > far[:-1])
    return lo[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def _without(w: Window, text: bytes, spans: pa.ListScalar) -> tuple[bytes, int, int]:
    """What is left of a text, bytes and runs removed. Removed words take the white space behind them along."""
    if spans.values is None or not len(spans.values):
        return text, 0, 0
    lo, hi = merged(spans.values.field(0).to_numpy().astype(np.int64), spans.values.field(1).to_numpy().astype(np.int64))
    if w.words:
        starts = word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        starts = np.append(starts, len(text))
        lo, hi = starts[lo], starts[hi]
    kept = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
    return kept, int((hi - lo).sum()), len(lo)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, spans in zip(b.column(1).cast(pa.binary()), b.column(2), strict=True):
            text = t.as_buffer().to_pybytes() if t.as_buffer() else b""
            kept, removed, runs = _without(BYTES, text, spans)
            out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _remainders(w: Window, k: int, drop_emptied: bool) -> Callable:
    """Cuts the spans in the last column out of the text in column k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 1
            kept, stays = [], []
            for t, spans in zip(b.column(k), b.column(n), strict=True):
                text = t.as_py()
                if text is not None and spans.is_valid:  # a cut through a character drops the rest of it
                    text = _without(w, text.encode(), spans)[0].decode(errors="ignore")
                kept.append(text)
                stays.append(not (drop_emptied and spans.is_valid and not (text or "").strip()))
            yield pa.record_batch([pa.array(kept, b.column(k).type) if i == k else b.column(i) for i in range(n)], names=b.schema.names[:n]).filter(pa.array(stays, pa.bool_()))

    return run


def with_spans(docs: DataFrame, window: Window = BYTES, block: int = BLOCK) -> DataFrame:
    """doc_id, text, d1, d2 and spans (null: nothing is repeated) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.withColumns(_identity()).join(repeated_spans(rows, window, block), ["d1", "d2"], "left")


def without_repeats(docs: DataFrame, drop_emptied: bool = False, window: Window = BYTES) -> DataFrame:
    """docs, every column as it was, but without the repeated passages in text; documents of which nothing but white
    space is left go if asked."""
    bounded_batches(docs.sparkSession)
    wide, own = renamed(docs)
    keyed = wide.withColumns(_identity(own["doc_id"], own["text"]))
    rows = keyed.join(repeated_spans(docs.select("doc_id", "text"), window), ["d1", "d2"], "left").select(*own.values(), "spans")
    return restored(rows.mapInArrow(_remainders(window, list(own).index("text"), drop_emptied), wide.schema), own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs).select("doc_id", text_or_empty().alias("text"), "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Every window by its position and hash: what the operator avoids, and fit for small tables only.
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, {2 * DEPTH})) AS m
      FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {DEPTH - 1})) AS i FROM t WHERE length(h) >= {2 * DEPTH})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
s AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {DEPTH} THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
x AS (SELECT rid, min(i) AS lo, max(i) + {DEPTH} AS hi FROM g GROUP BY rid, run),
y AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS before FROM x),
c AS (SELECT rid, sum(hi - lo)::BIGINT AS removed, count(*)::BIGINT AS spans,
             string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
      FROM y JOIN t USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN c USING (rid)
"""
