"""FM-index of word sequences: suffix order, a bit-packed wavelet tree over the Burrows-Wheeler transform, and backward
search of many patterns at once. Plain numpy over one shard of bounded size."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Symbols by bit planes from the highest bit on, the symbols with a 0 before those with a 1 on each level.

    A level is one bit a symbol, and one running count for each 64 of them."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        # Where the run of each symbol begins on the lowest level.
        held, at = np.unique(now, return_index=True)
        self.begin = np.zeros(alphabet, np.int64)
        self.begin[held] = at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol are before each place."""
        for k in range(self.bits):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where(symbol >> (self.bits - 1 - k) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at - self.begin[symbol]


def suffix_order(text: np.ndarray, most: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes of ``text`` in order, by doubling, and the classes of equal prefixes of 1, 2, 4, ... symbols.

    No two suffixes may be equal in their first ``most`` symbols."""
    n = len(text)
    rank, classes, k = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, {}, 1
    while True:
        classes[k] = rank
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        k *= 2
        if k >= most:
            return order, classes | {k: rank}


class Index:
    """Sequences of symbols (0, 1, ...), each with a mark at its end, in one index; matches are followed to ``depth`` symbols."""

    def __init__(self, sequences: np.ndarray, begin: np.ndarray, depth: int):
        sizes, self.depth = np.diff(begin), depth
        marks = len(sizes)
        n = len(sequences) + marks
        self.owner = np.repeat(np.arange(marks), sizes + 1)
        text = np.empty(n, np.int64)
        ends = begin[1:] + np.arange(marks)
        inside = np.ones(n, bool)
        inside[ends] = False
        # All marks differ and are least, so that no match runs over an end.
        text[ends], text[inside] = np.arange(marks), sequences + marks
        self.order, classes = suffix_order(text, max(int(sizes.max(initial=0)) + 1, depth))
        alphabet = int(sequences.max(initial=0)) + 2
        plain = np.where(inside, text - marks + 1, 0)
        counts = np.bincount(plain, minlength=alphabet)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.tree = WaveletTree(plain[self.order - 1], alphabet)
        # Runs of suffixes that agree in depth - 1 symbols: what a match is shortened to before its next step.
        reach = depth - 1
        half = 1 << (reach.bit_length() - 1)
        second = np.zeros(n, np.int64)
        second[: n - (reach - half)] = classes[half][reach - half :]
        a, b = classes[half][self.order], second[self.order]
        cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        run = np.cumsum(np.bincount(cuts, minlength=n)) - 1
        self.low, self.high = cuts[run], np.append(cuts[1:], n)[run]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that begin with the symbol and then with what those of low..high begin with."""
        s = symbol + 1
        both = self.tree.rank(np.concatenate([s, s]), np.concatenate([low, high]))
        return self.first[s] + both[: len(s)], self.first[s] + both[len(s) :]

    def matches(self, patterns: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pattern, place, low, high): where ``depth`` symbols of a pattern, from a place on, are found: the suffixes low..high.

        Patterns are streamed from their ends, all at once; symbols are those of the index, or -1 for one it lacks. A
        match of full depth loses its last symbol before the next step; one that can't be extended is taken up again
        one symbol further left."""
        sizes, all_ = np.diff(begin), len(self.order)
        who = np.flatnonzero(sizes >= self.depth)
        at, low, high, length = sizes[who] - 1, np.zeros(len(who), np.int64), np.full(len(who), all_), np.zeros(len(who), np.int64)
        found = []
        while len(who):
            symbol = patterns[begin[who] + at]
            low, high = self.step(np.maximum(symbol, 0), low, high)
            lost = (symbol < 0) | (low >= high)
            full = ~lost & (length == self.depth - 1)
            if full.any():
                found.append((who[full], at[full], low[full], high[full]))
            run = np.where(full, low, 0)
            low, high = np.where(lost, 0, np.where(full, self.low[run], low)), np.where(lost, all_, np.where(full, self.high[run], high))
            at = np.where(lost, at + length, at) - 1
            length = np.where(lost, 0, np.where(full, self.depth - 1, length + 1))
            # A match that begins at 0 or before, or can't reach the depth any more, ends the pattern.
            go = (at >= 0) & (at + 1 + length >= self.depth)
            who, at, low, high, length = who[go], at[go], low[go], high[go], length[go]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))
