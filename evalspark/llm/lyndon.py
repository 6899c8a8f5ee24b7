"""Suffix order of a byte shard by linear grouping, without recursion or renaming.

First pass: suffixes start in groups by first symbol, and groups are taken from the last
to the first. Each member points to the nearest suffix before it that is in a smaller
group; what lies between belongs to that suffix's prefix, which grows by the prefix of the
group as often as it is pointed to. So the pointed-to suffixes leave their group for a new
one right behind it. In the end a group holds the suffixes with one longest Lyndon prefix.
Second pass: from the smallest suffix on, the suffix before each placed one, and those on
its chain of pointers, take the next place of their group.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np


def suffix_groups(text: np.ndarray) -> tuple[list[int], list[int]]:
    """``(group, previous)``: first place of each suffix's group, and its pointer (-1: none).

    ``text`` ends with a symbol that is smaller than all others.
    """
    n = len(text)
    by_symbol = np.argsort(text, kind="stable")
    row = text[by_symbol]
    begin = np.concatenate(([True], row[1:] != row[:-1]))
    first = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    group = np.empty(n, np.int64)
    group[by_symbol] = first
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    last = np.zeros(n, np.int64)
    starts = np.flatnonzero(begin)
    last[starts] = np.append(starts[1:], n) - 1
    members, group, place, last = by_symbol.tolist(), group.tolist(), place.tolist(), last.tolist()
    previous = [-1] * n
    end = n - 1
    while end > 0:
        start = group[members[end]]
        pointed: dict[int, int] = {}
        if start == end:
            s = members[end]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                # One suffix moves to the end of its group.
                g = group[p]
                e = last[g]
                if e != g:
                    q, i = members[e], place[p]
                    members[i], place[q] = q, i
                    members[e], place[p] = p, e
                    last[g] = e - 1
                    group[p] = e
                    last[e] = e
        else:
            for s in sorted(members[start : end + 1]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            if max(pointed.values(), default=0) > 1:
                ranked = sorted(pointed, key=pointed.get, reverse=True)
                parts = [list(x) for _, x in groupby(ranked, key=pointed.get)]
            else:
                parts = [list(pointed)] if pointed else []
            for part in parts:
                left: set[int] = set()
                for p in part:
                    g = group[p]
                    left.add(g)
                    e = last[g]
                    q, i = members[e], place[p]
                    members[i], place[q] = q, i
                    members[e], place[p] = p, e
                    last[g] = e - 1
                ends = {g: last[g] + 1 for g in left}
                sizes: dict[int, int] = {}
                for p in part:
                    g = group[p]
                    new = group[p] = ends[g]
                    sizes[new] = sizes.get(new, 0) + 1
                for new, size in sizes.items():
                    last[new] = new + size - 1
        end = start - 1
    return group, previous


def suffix_array(text: np.ndarray) -> np.ndarray:
    group, previous = suffix_groups(text)
    n = len(text)
    order = [-1] * n
    order[0] = n - 1
    group[n - 1] = -1
    free = list(range(n))
    for i in range(n):
        s = order[i] - 1
        while s >= 0:
            g = group[s]
            if g < 0:
                break
            order[free[g]] = s
            free[g] += 1
            group[s] = -1
            s = previous[s]
    return np.array(order, np.int64)
