"""A compressed full-text index of one shard: Burrows-Wheeler transform in a wavelet matrix.

Numpy inside a task: all patterns of a shard take each backward step together.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols at least, by doubling the sorted length."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, done = len(text), 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        later = np.zeros(n, np.int64)
        later[: n - done] = rank[done:] + 1
        pair = rank * (n + 1) + later
        order = np.argsort(pair, kind="stable")
        new = np.concatenate(([False], pair[order[1:]] != pair[order[:-1]]))
        rank[order] = np.cumsum(new)
        done *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Bits:
    """A bit vector in 64-bit words with a running count per word; ``rank(i)``: ones before i."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        data = np.packbits(bits, bitorder="little")
        packed[: len(data)] = data
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """``text`` holds symbols from 1; 0 parts its pieces and is in no pattern."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        top = int(text.max()) + 1
        counts = np.bincount(text, minlength=top)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.levels: list[tuple[int, Bits, int]] = []
        row = text[self.order - 1]
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            one = (row >> bit & 1).astype(bool)
            bits = Bits(one)
            self.levels.append((bit, bits, len(row) - bits.ones))
            row = np.concatenate((row[~one], row[one]))
        # Rows before each symbol's own part of the last level.
        self.first = np.zeros(top, np.int64)
        self.first[:] = self.rank(np.arange(top), np.zeros(top, np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place that the wavelet matrix gives to ``symbol`` before row i (less ``first``: its count)."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with symbol followed by what ``[low, high)`` start with."""
        base = self.below[symbol] - self.first[symbol]
        return base + self.rank(symbol, low), base + self.rank(symbol, high)


def matching(index: FMIndex, text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics up to ``width`` of the patterns that end at ``ends``.

    A pattern goes on while its rows are more than its own place. Returns those that reach
    ``width``, as last positions, with their intervals of rows.
    """
    low = index.below[text[ends]]
    high = index.below[text[ends] + 1]
    for back in range(1, width):
        on = high - low > 1
        ends, low, high = ends[on], low[on], high[on]
        if not len(ends):
            break
        low, high = index.step(text[ends - back], low, high)
    on = high - low > 1
    return ends[on], low[on], high[on]
