"""Generalised suffix automaton of the word sequences of a block of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class ItemAutomaton:
    """All word runs of a block of items, streamed against in one step per word.

    ``pieces``: ``(item, words)``. Windows are ``width`` consecutive words of a piece; a
    piece of fewer words is one window. Transitions are one dict over ``state * n_words + word``.
    """

    def __init__(self, pieces: list[tuple[object, list[bytes]]], width: int):
        self.width = width
        self.words: dict[bytes, int] = {}
        coded = [(item, [self.words.setdefault(w, len(self.words)) for w in words]) for item, words in pieces]
        self.n = max(1, len(self.words))
        self.length, self.link, self.go = [0], [-1], {}
        edges: list[dict[int, int]] = [{}]
        whole: list[tuple[int, object]] = []
        reached: list[tuple[int, object]] = []
        for item, codes in coded:
            state = 0
            for k, code in enumerate(codes):
                state = self._extend(edges, state, code)
                if k + 1 >= width:
                    reached.append((state, item))
            if 0 < len(codes) < width:
                whole.append((state, item))
        for state, out in enumerate(edges):
            for code, to in out.items():
                self.go[state * self.n + code] = to
        self._windows(reached, whole)
        self.shortest = min([width] + [self.length[s] for s, _ in whole])

    def _extend(self, edges: list[dict[int, int]], last: int, code: int) -> int:
        to = edges[last].get(code)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(edges, last, code, to)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        edges.append({})
        p = last
        while p >= 0 and code not in edges[p]:
            edges[p][code] = new
            p = self.link[p]
        if p >= 0:
            q = edges[p][code]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(edges, p, code, q)
        return new

    def _split(self, edges: list[dict[int, int]], p: int, code: int, q: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        edges.append(dict(edges[q]))
        self.link[q] = copy
        while p >= 0 and edges[p].get(code) == q:
            edges[p][code] = copy
            p = self.link[p]
        return copy

    def _windows(self, reached: list[tuple[int, object]], whole: list[tuple[int, object]]) -> None:
        """``window[state]``: state of the last ``width`` words (-1: shorter);
        ``short[state]``: nearest whole short item that ends it; ``items[state]``: of a window."""
        count = len(self.length)
        self.window, self.short = [-1] * count, [-1] * count
        ends = {s for s, _ in whole}
        for state in sorted(range(1, count), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= self.width:
                self.window[state] = self.window[up] if self.length[up] >= self.width else state
            self.short[state] = state if state in ends else self.short[up]
        self.items: dict[int, set] = {}
        for state, item in reached:
            self.items.setdefault(self.window[state], set()).add(item)
        for state, item in whole:
            self.items.setdefault(state, set()).add(item)

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``(begin, end, state)`` of every occurrence of a window in ``words``.

        Stretches of known words that are too short for any window are passed over.
        """
        known = self.words.get
        codes = np.array([known(w, -1) for w in words], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        go, link, lengths, n = self.go.get, self.link, self.length, self.n
        for begin, end in edge.reshape(-1, 2).tolist():
            if end - begin < self.shortest:
                continue
            state = length = 0
            for i, code in enumerate(codes[begin:end].tolist(), begin + 1):
                to = go(state * n + code)
                while to is None:
                    state = link[state]
                    length = lengths[state]
                    to = go(state * n + code)
                state = to
                length += 1
                if length >= self.width:
                    yield i - self.width, i, self.window[state]
                short = self.short[state]
                if short >= 0 and lengths[short] > length:
                    short = self.short[link[short]] if short == state else -1
                while short > 0:
                    yield i - lengths[short], i, short
                    short = self.short[link[short]]
