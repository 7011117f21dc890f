"""Distinct words with their token ids: each word of a step is encoded once, frequent ones stay in a bounded table."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable

import numpy as np

from tarnspark.llm.common import ranges


class WordTable:
    """encode_new maps distinct words to their flat ids and the number of ids of each."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept_words: int) -> None:
        self.encode_new, self.kept_words = encode_new, kept_words
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and the number of ids of each text, of which counts gives the words."""
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0)
        start, length, ids = self.start, self.length, self.ids
        if len(miss):
            fresh: dict[str, int] = defaultdict(itertools.count(len(self.start)).__next__)
            at[miss] = np.fromiter(map(fresh.__getitem__, map(words.__getitem__, miss.tolist())), np.int64, len(miss))
            flat, sizes = self.encode_new(list(fresh))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            ids = self.ids
            start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
            length = np.concatenate([self.length, sizes])
            if len(self.known) + len(fresh) <= self.kept_words:
                self.known |= fresh
                self.start, self.length, self.used = start, length, self.used + len(flat)
        total = np.append(0, np.cumsum(length[at]))
        ends = np.cumsum(counts)
        return ids[ranges(start[at], length[at])], total[ends] - total[ends - counts]


def cut(sizes: np.ndarray, limit: int):
    """Ranges whose summed sizes (given cumulated) stay near limit."""
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b
