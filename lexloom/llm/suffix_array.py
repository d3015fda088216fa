"""Suffix arrays by linear grouping.

Suffixes are first sorted into groups by their longest Lyndon prefix.  The groups are worked off in descending
order: each member finds its previous smaller suffix by following pointers that are known already, and the group of
that suffix is refined, as its Lyndon prefix grows by the member's.  Then one pass from the left emits the order
inside every group: a suffix whose Lyndon prefix ends where an emitted suffix begins takes the next free place of its
group.  Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of a sequence of small non-negative integers; the end counts as smaller than any of them."""
    n = len(text)
    if not n:
        return []
    codes = np.asarray(text)
    sa = np.argsort(codes, kind="stable")
    ranked = codes[sa]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(first, sizes)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    sa, group, place, size = sa.tolist(), group.tolist(), place.tolist(), dict(zip(first.tolist(), sizes.tolist(), strict=True))
    smaller = [-1] * n

    end = n
    while end > 0:
        begin = group[sa[end - 1]]
        members = sorted(sa[begin:end]) if end - begin > 1 else [sa[begin]]
        found = []
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                found.append(p)
        end = begin
        if not found:
            continue
        moved = defaultdict(list)
        for p, times in Counter(found).items():
            moved[group[p], times].append(p)
        for (low, _), ps in sorted(moved.items(), key=lambda x: -x[0][1]) if len(moved) > 1 else moved.items():
            tail = low + size[low]
            for p in ps:  # to the tail of its group, which becomes a group of its own
                tail -= 1
                q, at = sa[tail], place[p]
                sa[at], place[q] = q, at
                sa[tail], place[p] = p, tail
            if tail > low:
                size[low] = tail - low
                size[tail] = len(ps)
                for p in ps:
                    group[p] = tail

    free = list(range(n))
    placed = [False] * n
    s = n - 1
    at = -1
    while True:
        while s >= 0 and not placed[s]:
            g = group[s]
            sa[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
        at += 1
        if at == n:
            return sa
        s = sa[at] - 1
