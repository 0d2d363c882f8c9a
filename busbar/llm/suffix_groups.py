"""Suffix arrays by linear grouping.

Every suffix has a longest Lyndon prefix. Suffixes are put into groups that have
such a prefix in common, so far as it is known; at first that is one symbol. The
groups are taken from the highest to the lowest. For each suffix of the group
the previous-smaller pointer names the nearest suffix on its left that is in a
lower group; that one's prefix is longer than was known, by one copy of the
group's prefix for each pointer it gets, and it moves to a new group behind its
own. In the end the suffixes of a group agree in their Lyndon prefix, groups are
in order, and one pass from the smallest suffix on emits the order inside each
group: what stands before a suffix, and all that the pointers lead to from
there, are the next of their groups. No symbol is ever renamed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of `symbols` (numbers from 0 up) in ascending order; a proper prefix comes first."""
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    first = np.append(True, sorted_text[1:] != sorted_text[:-1])
    start_at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group = np.empty(n, np.int64)  # by suffix: the first place of its group
    group[order] = start_at
    place = np.empty(n, np.int64)  # by suffix: its own place
    place[order] = np.arange(n)
    sizes = np.zeros(n, np.int64)  # by first place
    starts = np.flatnonzero(first)
    sizes[starts] = np.diff(np.append(starts, n))
    group, previous = _grouped(order.tolist(), group.tolist(), place.tolist(), sizes.tolist())
    return np.array(_emitted(group, previous)[1:], np.int64)


def _grouped(at: list[int], group: list[int], place: list[int], sizes: list[int]) -> tuple[list[int], list[int]]:
    """Group and previous-smaller pointer of every suffix. The last suffix is alone in the lowest group, and index -1 means it."""
    previous = [-1] * len(at)
    end = len(at) - 1
    while end > 0:
        start = group[at[end]]
        if start == end:
            s = at[end]
            p = s - 1
            while group[p] > start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                g = group[p]
                left = sizes[g] - 1
                if left:
                    sizes[g] = left
                    new = g + left
                    other, hole = at[new], place[p]
                    at[hole], at[new] = other, p
                    place[other], place[p] = hole, new
                    group[p] = new
                    sizes[new] = 1
        else:
            by_count: dict[int, list[int]] = {}
            last, count = -1, 0
            for s in sorted(at[start : end + 1]):
                p = s - 1
                while group[p] >= start:
                    p = previous[p]
                previous[s] = p
                if p == last:
                    count += 1
                    continue
                if last >= 0:
                    by_count.setdefault(count, []).append(last)
                last, count = p, 1
            if last >= 0:
                by_count.setdefault(count, []).append(last)
            for count in sorted(by_count, reverse=True):
                moved = by_count[count]
                old = [group[p] for p in moved]
                for p, g in zip(moved, old):
                    left = sizes[g] = sizes[g] - 1
                    new = g + left
                    other, hole = at[new], place[p]
                    at[hole], at[new] = other, p
                    place[other], place[p] = hole, new
                fresh = [g + sizes[g] for g in old]
                for p, g in zip(moved, fresh):
                    group[p] = g
                    sizes[g] += 1
        end = start - 1
    return group, previous


def _emitted(group: list[int], previous: list[int]) -> list[int]:
    n = len(group)
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            k = free[g]
            free[g] = k + 1
            out[k] = s
            placed[s] = 1
            s = previous[s]
    return out


def repeated_starts(symbols: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of `starts` begin a run of `size` symbols that also begins at another of `starts`; none reaches over the end."""
    found = np.zeros(len(symbols), bool)
    valid = np.zeros(len(symbols), bool)
    valid[starts] = True
    order = suffix_array(symbols)
    order = order[valid[order]]  # equal runs stand side by side
    a, b = order[:-1], order[1:]
    for k in range(size):
        same = symbols[a + k] == symbols[b + k]
        a, b = a[same], b[same]
    found[a] = found[b] = True
    return found[starts]
