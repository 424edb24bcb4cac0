"""Suffix arrays by linear grouping construction.

Suffixes are grouped by their Lyndon prefixes. Groups are taken in descending order; each suffix of the group points to
the nearest suffix before it that lies in a smaller group (previous-smaller pointers), and the suffixes pointed at move
to a group of their own right above the one they were in, those pointed at most often first. After that, each group's
suffixes are put in order by walking the array once and following the pointers: a suffix is placed when the suffix
after its Lyndon prefix is reached. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of positive integers; a suffix that is another's prefix comes first."""
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)
    text[:-1] = symbols
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[heads, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, sizes)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    order, group, at = order.tolist(), group.tolist(), at.tolist()
    size = [0] * n
    for h, s in zip(heads.tolist(), sizes.tolist(), strict=True):
        size[h] = s
    smaller = [-1] * n

    high = n
    while high > 1:
        start = group[order[high - 1]]
        if high - start == 1:
            s = order[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:  # p alone moves above the rest of its group
                    tail, x = g + k - 1, at[p]
                    y = order[tail]
                    order[x], at[y] = y, x
                    order[tail], at[p] = p, tail
                    size[g] = k - 1
                    size[tail] = 1
                    group[p] = tail
            high = start
            continue
        pointed: dict[int, int] = {}
        for s in sorted(order[start:high]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        most = max(pointed.values(), default=0)
        for times in range(most, 0, -1):
            moving: dict[int, list[int]] = {}
            for p, c in pointed.items():
                if c == times:
                    moving.setdefault(group[p], []).append(p)
            for g, ps in moving.items():
                k = size[g]
                if len(ps) == k:
                    continue
                tail = g + k
                for p in ps:
                    tail -= 1
                    x, y = at[p], order[tail]
                    order[x], at[y] = y, x
                    order[tail], at[p] = p, tail
                for p in ps:
                    group[p] = tail
                size[g] = k - len(ps)
                size[tail] = len(ps)
        high = start

    free = list(range(n))  # free[g]: next place of the group that starts at g
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return np.array(out[1:], np.int64)
