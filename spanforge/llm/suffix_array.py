"""Suffix arrays by linear grouping: no recursion, no renaming of a shorter string.

Suffixes are held in groups that share a Lyndon prefix. Groups are processed in descending
order; every member points at its previous smaller suffix, and those that are pointed at
move, by how often they are, into new groups right after their old ones. What is left is an
order of groups; a second sweep, in ascending order, emits each group's suffixes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(text) -> list[int]:
    """Start positions of the suffixes of a sequence of non-negative integers, in order."""
    n = len(text) + 1
    # suffixes are numbered from 1; n is the sentinel's, which is smaller than any other, and 0
    # the bottom of all pointers. group[i]: the first place of i's group in ``order``
    symbols = np.zeros(n, np.int64)
    symbols[:-1] = (np.frombuffer(text, np.uint8) if isinstance(text, bytes) else np.asarray(text, np.int64)) + np.int64(1)
    by_symbol = np.argsort(symbols, kind="stable")
    new = np.flatnonzero(np.diff(symbols[by_symbol], prepend=-1))
    lengths = np.diff(np.append(new, n))
    order = (by_symbol + 1).tolist()
    places, firsts = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    places[by_symbol + 1], firsts[by_symbol + 1] = np.arange(n), np.repeat(new, lengths)
    place, group = places.tolist(), firsts.tolist()
    size = [0] * (n + 1)
    for at, length in zip(new.tolist(), lengths.tolist()):
        size[at] = length
    group[0] = -1
    prev = [0] * (n + 1)
    resolved = [False] * (n + 1)
    high = n
    groups_final: list[int] = []
    # ---- phase 1: groups in descending order ----
    while high > 0:
        low = group[order[high - 1]]
        groups_final.append(low)
        if high - low == 1:  # most groups: one suffix, one pointer, one move
            i = order[low]
            j = i - 1
            while j > 0 and group[j] >= low:
                j = prev[j] if resolved[j] else j - 1
            prev[i], resolved[i], high = j, True, low
            if j and size[g := group[j]] > 1:
                size[g] -= 1
                end = g + size[g]
                other, p = order[end], place[j]
                order[end], order[p], place[other], place[j] = j, other, p, end
                size[end], group[j] = 1, end
            continue
        pointed = []
        for i in sorted(order[low:high]):
            j = i - 1
            # previous smaller suffix; pointers of processed suffixes shorten the walk
            while j > 0 and group[j] >= low:
                j = prev[j] if resolved[j] else j - 1
            prev[i], resolved[i] = j, True
            if j:
                pointed.append(j)
        by_count: dict[int, list[int]] = {}
        if len(set(pointed)) == len(pointed):
            by_count[1] = pointed
        else:
            for j, k in Counter(pointed).items():
                by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[k]:
                moved.setdefault(group[j], []).append(j)
            for g, js in moved.items():
                # swap the movers to the end of their old group; they form the group after it
                end = g + size[g]
                for j in js:
                    end -= 1
                    other, p = order[end], place[j]
                    order[end], order[p] = j, other
                    place[other], place[j] = p, end
                size[g] -= len(js)
                if size[g]:
                    size[end] = len(js)
                    for j in js:
                        group[j] = end
                else:
                    size[g] = len(js)
        high = low
    # ---- phase 2: emit each group's order ----
    out = [0] * n
    filled = {g: g for g in groups_final}
    out[0] = n
    done = [False] * (n + 1)
    done[n] = True
    for k in range(n):
        j = out[k] - 1
        while j > 0 and not done[j]:
            g = group[j]
            out[filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = prev[j]
    return [i - 1 for i in out[1:]]

