"""A compressed full-text index over words: a wavelet matrix of the Burrows-Wheeler transform.

What an index keeps: the matrix' bit planes, one bit a row for where a new window
starts, and the first place of each window that occurs twice or more; a window that
occurs once is where it was read.  The suffix order is dropped once these are made.

Queries run side by side as arrays.  A window of fixed depth is found by backward
search; when the search goes on to the left, the interval is widened back to the
window's depth by the runs of rows that agree so far, so each further word costs one
step and not a whole search.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Rank of ones, with counts every 64 places."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
        padded[: len(bit)] = bit
        plane = np.packbits(padded, bitorder="little").view("<u8")
        self.ones = np.zeros(len(plane) + 1, np.int64)
        np.cumsum(np.bitwise_count(plane), out=self.ones[1:])
        self.plane = np.append(plane, np.uint64(0))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before the place `at`."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.plane[word] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.plane[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank queries on a sequence of small numbers: one bit plane for each bit, with counts every 64 places."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.n = len(values)
        self.planes, self.zeros = [], []
        values = values.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> np.uint32(level) & np.uint32(1)).astype(bool)
            self.planes.append(BitVector(bit))
            self.zeros.append(int(self.n - self.planes[-1].ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])
        # where each symbol's places end up: the walk from place 0, made once
        every = np.arange(symbols, dtype=np.int64)
        self.base = self.walk(every, np.zeros(symbols, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self.planes[level].rank(at)
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place `at`."""
        return self.walk(symbol, at) - self.base[symbol]


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and each key's rank among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = False
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class FmIndex:
    """The index of a text of symbols, 0 being the separator, for patterns of up to window + 1 words.

    Suffixes are ordered by as many words as that takes; the order of those equal
    so far does not matter to patterns within them.
    """

    def __init__(self, text: np.ndarray, window: int):
        self.text, self.window = text, window
        n, symbols = len(text), int(text.max()) + 1 if len(text) else 1
        width = max(1, symbols.bit_length())
        depth = max(1, min(62 // width, window))
        behind = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, n), a.dtype)])
        key = text.astype(np.int64)
        for k in range(1, depth):  # the first few words fit into one number
            key = key << width | behind(text, k)
        order, rank = ranks(key)
        halves = (rank, depth)
        while depth <= window and n:
            if depth <= window:
                halves = (rank, depth)
            order, rank = ranks(rank * (n + 1) + behind(rank + 1, depth))
            depth *= 2
        counts = np.bincount(text, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        self.last_column = WaveletMatrix(text[order - 1], symbols)
        # runs of rows that agree in a whole window, by two overlapping halves; the earliest place of those of two rows or more
        half, size = halves
        at = np.minimum(order + (window - size), max(0, n - 1))
        one, two = half[order], half[at]
        start = np.ones(n, bool)
        start[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.starts = BitVector(start)
        begins = np.flatnonzero(start)
        long_ = np.diff(np.append(begins, n)) > 1
        self.run_start = begins.astype(np.int32)
        self.repeats = BitVector(long_)
        self.earliest = (np.minimum.reduceat(order, begins) if n else begins)[long_].astype(np.int32)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bound of an interval after its pattern is extended by a word to the left."""
        return self.first[symbol] + self.last_column.rank(symbol, at)

    def find(self, pattern: np.ndarray) -> tuple[int, int]:
        """The interval of rows that start with a pattern of window + 1 words at most, by backward search."""
        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.text), np.int64)
        for symbol in pattern[::-1]:
            if not 0 < symbol < len(self.first):
                return 0, 0
            s = np.array([symbol])
            lo, hi = self.step(s, lo), self.step(s, hi)
            if lo[0] >= hi[0]:
                return 0, 0
        return int(lo[0]), int(hi[0])

    def matching(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams the pieces [begin, end) of the indexed text from right to left through the index.

        For each place that starts a whole window inside its piece: the place, whether
        the window occurs more than once in the index, and where first.  As the pieces are
        in the index, no interval is ever empty and its lower bound will do.
        """
        lo = np.zeros(len(begin), np.int64)
        active, place = np.arange(len(begin)), end - 1
        out: list[tuple[np.ndarray, ...]] = []
        depth = 0
        while len(active):
            lo = self.step(self.text[place], lo)
            depth += 1
            if depth >= self.window:  # a word too deep or just right: the run of rows at the window's depth
                run = self.starts.rank(lo + 1) - 1
                lo = self.run_start[run].astype(np.int64)
                again = self.repeats[run]
                earliest = place.copy()  # of a window that occurs once
                earliest[again] = self.earliest[self.repeats.rank(run[again])]
                out.append((place, again, earliest))
            on = place > begin[active]
            active, lo, place = active[on], lo[on], place[on] - 1
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
