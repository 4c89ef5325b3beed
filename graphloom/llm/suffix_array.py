"""Suffix arrays by grouping suffixes under their Lyndon prefixes, in linear time and without recursion (Baier, 2016)."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order; a suffix that begins another comes before it.

    First phase: suffixes stand in groups by first symbol; groups are taken in descending order.  The pointer of each
    suffix of a group goes to the nearest earlier suffix of a smaller group, and suffixes that the group points to, by
    how often and by their own group, move to a new group right after their old one.  In the end a group holds the
    suffixes with one Lyndon prefix.  Second phase: in ascending order, each suffix tells the place of the one before it
    in the text, and of those that the pointers lead to from there, in their groups.
    """
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    text = np.concatenate((np.asarray(symbols, dtype=np.int64), [np.iinfo(np.int64).min]))
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    start_of = np.empty(n, dtype=np.int64)
    start_of[order] = np.repeat(first, np.diff(np.append(first, n)))
    group, place = start_of.tolist(), order.tolist()
    size, members = [0] * n, [None] * n
    ends = first.tolist() + [n]
    for a, b in zip(ends, ends[1:]):
        size[a], members[a] = b - a, place[a:b]
    before = [-1] * n
    for x in range(n - 1, 0, -1):
        if not size[x]:
            continue
        if size[x] == 1:  # the usual case, written out
            for s in members[x]:
                if group[s] == x:
                    break
            p = s - 1
            while p >= 0 and group[p] >= x:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    size[g] = k - 1
                    g += k - 1
                    group[p], size[g], members[g] = g, 1, (p,)
            continue
        counts: dict[int, int] = {}
        for s in sorted(members[x]):
            if group[s] == x:
                p = s - 1
                while p >= 0 and group[p] >= x:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
        if not counts:
            continue
        by: dict[tuple[int, int], list[int]] = {}
        for p, k in counts.items():
            by.setdefault((k, group[p]), []).append(p)
        for k, g in sorted(by, reverse=True) if len(by) > 1 else by:
            moved = by[k, g]
            left = size[g] - len(moved)
            if left:
                size[g] = left
                new = g + left
                size[new], members[new] = len(moved), moved
                for p in moved:
                    group[p] = new
    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # by a group's start: its next free place
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return np.array(out[1:], dtype=np.int64)


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in suffix-array order, all at least `length` long: the number of the group with equal first symbols."""
    if not len(order):
        return order
    differ = np.zeros(len(order), dtype=bool)
    for k in range(length):
        column = symbols[order + k]
        differ[1:] |= column[1:] != column[:-1]
    return np.cumsum(differ)
