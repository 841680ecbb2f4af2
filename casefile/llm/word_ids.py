"""Ids of words that a worker has met, told apart by hashes, so that a batch of texts is encoded in arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from casefile.llm.common import span_hashes

#: Words that a worker remembers (of up to WORD_IDS ids each); when they are more, the half not met
#: for longer goes.
WORDS, WORD_IDS = 400_000, 32


class WordIds:
    """Ids of words by two hashes of their bytes. ``always`` are the ids of word 0, which has no bytes.
    ``encode`` gives, of words in a row (bytes and their sizes), the ids in a row and each one's end."""

    def __init__(self, always: list[int], encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], words: int = WORDS):
        self.encode, self.words = encode, words
        #: Words that can be found: hashes, in the order of the first, and numbers.
        self.h = self.g = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        #: Of each number: where its ids begin, how many they are, and the batch that met it last.
        self.ids, self.begin, self.size = np.array(always, np.uint32), np.zeros(1, np.int64), np.array([len(always)])
        self.last, self.now = np.zeros(1, np.int64), 0

    def of(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Numbers of words, valid until the next call."""
        self.tidy()
        if not len(start):
            return np.zeros(0, np.int64)
        h, g = span_hashes(data, start, stop)
        order = np.argsort(h)
        new = np.append(True, np.diff(h[order]) != 0)
        if (g[order][1:] != g[order][:-1])[~new[1:]].any():  # two words with the same first hash
            order = np.lexsort((g, h))
            new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0))
        distinct = order[new]  # one place of each distinct word
        nth = np.empty(len(start), np.int64)
        nth[order] = np.cumsum(new) - 1
        number = self.found(h[distinct], g[distinct])
        missing = np.flatnonzero(number < 0)
        if len(missing):
            at = distinct[missing]
            length = stop[at] - start[at]
            where = np.repeat(start[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
            number[missing] = self.added(h[at], g[at], *self.encode(data[where], length))
        return number[nth]

    def found(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = (self.h[at] == h) & (self.g[at] == g)
            out[hit] = self.number[at[hit]]
            self.last[out[hit]] = self.now
        return out

    def added(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = np.diff(end, prepend=0)
        number = len(self.size) + np.arange(len(size))
        self.begin = np.concatenate([self.begin, len(self.ids) + end - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        self.last = np.concatenate([self.last, np.full(len(size), self.now)])
        h, g, number_ = (np.concatenate(x) for x in ((self.h, h), (self.g, g), (self.number, number)))
        order = np.argsort(h, kind="stable")
        self.h, self.g, self.number = h[order], g[order], number_[order]
        return number

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and where each word's end."""
        n, begin = self.size[numbers], self.begin[numbers]
        end = np.cumsum(n)
        return self.ids[np.repeat(begin - end + n, n) + np.arange(end[-1] if len(end) else 0)], end

    def tidy(self) -> None:
        """Forget the older half of too many words, and words of many ids."""
        self.now += 1
        if len(self.size) > self.words:
            keep = (self.last > np.median(self.last[1:])) & (self.size <= WORD_IDS)
            keep[0] = True
            self.ids, end = self.join(np.flatnonzero(keep))
            self.size, self.last = self.size[keep], self.last[keep]
            self.begin = end - self.size
            stay = keep[self.number]
            self.h, self.g, self.number = self.h[stay], self.g[stay], (np.cumsum(keep) - 1)[self.number[stay]]
