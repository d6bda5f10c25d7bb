"""Suffix arrays by linear grouping.

Phase one sorts the suffixes into groups of equal longest Lyndon prefix: groups are taken in descending order; each
suffix of a group points to the nearest earlier suffix of a lower group, and what is pointed to leaves its own group for
a new one just behind it, apart for each number of pointers. Phase two emits the order inside the groups: the suffixes
come up in ascending order, and each one places its left neighbour, that one's previous smaller suffix and so on at the
next free place of their groups. Nothing is renamed and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of an array of non-negative integers."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A terminal symbol below all others at the end.
    _, ranks = np.unique(text, return_inverse=True)
    symbols = np.append(ranks + 1, 0)
    size = n + 1
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols)
    begin = np.cumsum(counts) - counts
    lengths = dict(zip(begin.tolist(), counts.tolist()))
    group, place, order = begin[symbols].tolist(), np.empty(size, np.int64), order.tolist()
    place[order] = np.arange(size)
    place = place.tolist()
    before = [-1] * size

    end = size
    while end > 0:
        g = group[order[end - 1]]
        if end - g == 1:
            i = order[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:  # a single pointer: its target leaves alone
                old = group[j]
                k = lengths[old] - 1
                if k:
                    last, at = old + k, place[j]
                    other = order[last]
                    order[at], order[last], place[other], place[j] = other, j, at, last
                    lengths[old], lengths[last], group[j] = k, 1, last
            end = g
            continue
        pointed: list[int] = []
        times: list[int] = []
        for i in sorted(order[g:end]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                if pointed and pointed[-1] == j:
                    times[-1] += 1
                else:
                    pointed.append(j)
                    times.append(1)
        by_times: dict[int, list[int]] = {}
        for j, k in zip(pointed, times):
            by_times.setdefault(k, []).append(j)
        for k in sorted(by_times, reverse=True):
            leaving: dict[int, list[int]] = {}
            for j in by_times[k]:
                leaving.setdefault(group[j], []).append(j)
            for old, members in leaving.items():
                free = old + lengths[old]
                for j in members:
                    free -= 1
                    at, other = place[j], order[free]
                    order[at], order[free], place[other], place[j] = other, j, at, free
                m = len(members)
                lengths[old] -= m
                lengths[free] = m
                for j in members:
                    group[j] = free
        end = g

    out, free, placed = [-1] * size, {}, bytearray(size)
    out[0], placed[n] = n, 1
    for r in range(size):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free.get(g, g)
            out[at], free[g], placed[j] = j, at + 1, 1
            j = before[j]
    return np.array(out[1:], np.int64)
