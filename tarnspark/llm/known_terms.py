"""Known words of texts, found and counted without an object for each word: words are hashed in bulk and met in one table.

A word is a run of letters and digits (`[^\\W_]+`), lower-cased; it is known by a 64-bit hash of its UTF-8 bytes: the
polynomial of its bytes' values, taken out of running sums, and a finaliser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

from tarnspark.llm.common import mixed

#: Bytes of text that one numpy step works on, and of the longest piece of a text: longer words are not known.
STEP, PIECE = 1 << 16, 1 << 19

_WORD = re.compile(r"[^\W_]+")
#: Of Latin-1: letters in lower case and digits stay, all else is a space.
_LATIN = bytes(ord(chr(c).lower()) if _WORD.match(chr(c)) else 32 for c in range(256))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def plain(text: str) -> bytes:
    """A text's words as UTF-8, with spaces between them."""
    if text.isascii():
        return text.encode().translate(_LATIN)
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        return " ".join(_WORD.findall(text.lower())).encode()


def words_of(text: str) -> list[str]:
    return plain(text).decode().split()


@cache
def _powers(base: int) -> np.ndarray:
    p = np.full(PIECE + STEP, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of plain text (which begins and ends with a space) begins, and its hash."""
    solid = data != 32
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE)[: len(data)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64))[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    a = 0
    while len(data) - a > PIECE:
        b = data.rfind(b" ", a + 1, a + PIECE)
        if b > 0:
            yield data[a:b]
        else:
            b = data.find(b" ", a + PIECE)
        a = b if b > 0 else len(data)
    yield data[a:]


@dataclass
class Terms:
    """Known words, by number."""

    key: np.ndarray  # hash of each
    slot: np.ndarray  # their numbers by hash, each in the first slot that was free (a power of two of them); -1: free

    @staticmethod
    def of(words: list[str]) -> Terms:
        """Different words, in order; of two with one hash the second is never found."""
        data = np.frombuffer(" ".join(["", *words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(data == 32)
        cuts = [0]
        while cuts[-1] < len(data) - 1:
            cuts.append(max(int(ends[np.searchsorted(ends, cuts[-1] + PIECE, "right") - 1]), int(ends[np.searchsorted(ends, cuts[-1], "right")])))
        key = np.concatenate([np.zeros(0, np.uint64), *(hashes(data[a : b + 1])[1] for a, b in zip(cuts, cuts[1:], strict=False))])
        slot, left, step = np.full(1 << (4 * len(key)).bit_length(), -1, np.int32), np.arange(len(key)), 0
        while len(left):
            at = _slots(key[left], step, len(slot))
            free = slot[at] < 0
            slot[at[free]] = left[free]
            left, step = left[slot[at] != left], step + 1
        return Terms(key, slot)

    def __len__(self) -> int:
        return len(self.key)

    def renumbered(self, number: np.ndarray) -> Terms:
        key = np.empty_like(self.key)
        key[number] = self.key
        return Terms(key, np.append(number, -1)[self.slot].astype(np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words of these hashes, -1: not known."""
        found, left, step = np.full(len(h), -1), np.arange(len(h)), 0
        while len(left):
            term = self.slot[_slots(h[left], step, len(self.slot))]
            left, term = left[term >= 0], term[term >= 0]
            hit = self.key[term] == h[left]
            found[left[hit]] = term[hit]
            left, step = left[~hit], step + 1
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, term, count) of all known words in texts, by text and term."""
        out, held, of, size = [], [], [], 0
        for k, text in enumerate(texts):
            data = plain(text)
            for piece in [data] if len(data) <= PIECE else _pieces(data):
                if size + len(piece) > STEP and held:
                    out.append(self._met(held, of))
                    held, of, size = [], [], 0
                held.append(piece)
                of.append(k)
                size += len(piece) + 1
        if held:
            out.append(self._met(held, of))
        met = np.concatenate([np.zeros(0, np.int64), *out])
        met.sort()
        first = np.flatnonzero(np.append(True, met[1:] != met[:-1])) if len(met) else np.zeros(0, np.int64)
        pairs = met[first]
        return pairs >> 32, pairs & 0xFFFFFFFF, np.diff(np.append(first, len(met)))

    def _met(self, pieces: list[bytes], of: list[int]) -> np.ndarray:
        """Known words of pieces: the number of the text and the term, in one."""
        starts, h = hashes(np.frombuffer(b" ".join([b"", *pieces, b""]), np.uint8))
        begin = np.cumsum([1, *(len(p) + 1 for p in pieces[:-1])])
        term = self.find(h)
        text = np.repeat(np.array(of), np.diff(np.append(np.searchsorted(starts, begin), len(starts))))
        return (text << 32 | term)[term >= 0]


def _slots(h: np.ndarray, step: int, size: int) -> np.ndarray:
    return ((h & np.uint64(size - 1)).astype(np.int64) + step) & (size - 1)
