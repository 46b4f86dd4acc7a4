"""Suffix arrays of many short strings by grouping suffixes by their Lyndon prefixes, in array operations."""

from __future__ import annotations

import numpy as np


def keys(matrix: np.ndarray) -> np.ndarray:
    """For each place the next eight bytes as one number; rows are strings, padded with zeros behind their end."""
    out = matrix.astype(np.uint64)
    for step in (1, 2, 4):
        moved = np.zeros_like(out)
        moved[:, :-step] = out[:, step:]
        out = (out << np.uint64(8 * step)) | moved
    return out.ravel()


def _greater(key: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether suffix a of a row is greater than its later suffix b; of two equal as far as b goes, a is greater."""
    x, y = key[a], key[b]
    out = x > y
    tie = np.flatnonzero(x == y)
    a, b, end = a[tie] + 8, b[tie] + 8, end[tie]
    while len(tie):
        over = b >= end
        out[tie[over]] = True
        go = ~over
        tie, a, b, end = tie[go], a[go], b[go], end[go]
        x, y = key[a], key[b]
        out[tie] = x > y
        go = x == y
        tie, a, b, end = tie[go], a[go] + 8, b[go] + 8, end[go]
    return out


def next_smaller(key: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller; the end of its string if there is none.

    Everything between a suffix and its pointer is greater. A greater target's own pointer is taken over, whether it
    is final or not, so pointers double their reach until they stand at a smaller suffix.
    """
    to = place + 1
    now = np.flatnonzero(to < end)
    at = np.empty(int(end.max()) + 1 if len(end) else 1, np.int64)  # place -> row in the arrays
    at[place] = np.arange(len(place))
    while len(now):
        smaller = _greater(key, place[now], to[now], end[now])
        now = now[~smaller]
        to[now] = to[at[to[now]]]
        now = now[to[now] < end[now]]
    return to


def _refine(rank: np.ndarray, among: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Orders the members ``among`` of each rank by ``by`` and gives those that still share a rank.

    Ranks count the smaller ones, so no other rank moves; all members of a rank have to be among them.
    """
    n = len(among)
    if not n:
        return among
    old = rank[among]
    if old.min() != old.max():
        if by.dtype == np.uint64:  # as small numbers, to sort by both at once
            order = np.argsort(by)
            step = np.zeros(n, np.int64)
            step[order[1:]] = by[order[1:]] != by[order[:-1]]
            by = np.empty(n, np.int64)
            by[order] = np.cumsum(step[order])
        by = old << 32 | by + 1
    order = np.argsort(by)
    old, by = old[order], by[order]
    count = np.arange(n)
    first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), count, 0))
    change = np.append(True, by[1:] != by[:-1])
    rank[among[order]] = old + np.maximum.accumulate(np.where(change, count, 0)) - first
    return among[order[~(change & np.append(change[1:], True))]]


def group_ranks(key: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each suffix's group: the number of suffixes with a smaller Lyndon prefix, by blocks of eight bytes."""
    def block(rows: np.ndarray, k: int) -> np.ndarray:
        left = np.clip(length[rows] - 8 * k, 0, 8)
        here = np.minimum(place[rows] + 8 * k, len(key) - 1)
        mask = np.where(left > 0, ~np.uint64(0) << ((8 - np.maximum(left, 1)) * 8).astype(np.uint64), np.uint64(0))
        return key[here] & mask

    rank = np.zeros(len(place), np.int64)
    every = np.arange(len(place))
    tied = _refine(rank, every, block(every, 0))
    k = 1
    while True:
        # A rank goes on if one of its words does; those that end come first.
        tied = tied[np.argsort(rank[tied])]
        first = np.append(True, rank[tied][1:] != rank[tied][:-1])[:len(tied)]
        longest = np.maximum.reduceat(length[tied], np.flatnonzero(first)) if len(tied) else length[tied]
        among = tied[(longest > 8 * k)[np.cumsum(first) - 1]]
        if not len(among):
            return rank
        tied = _refine(rank, among, block(among, k))
        k += 1


def suffix_order(matrix: np.ndarray, size: np.ndarray, depth: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The asked-for places (flat) in the order of their suffixes, and whether each agrees with the one before it on
    ``depth`` bytes. Rows of ``matrix`` are strings of ``size`` bytes, at least 16 zeros behind the longest.

    A suffix is its Lyndon prefix followed by its next smaller suffix. Suffixes are grouped by Lyndon prefix, and a
    group's order is that of what follows: the groups met along the pointers, as far as ``depth`` bytes.
    """
    rows, width = matrix.shape
    key = keys(matrix)
    column = np.arange(width)
    place = np.flatnonzero((column < size[:, None]).ravel())
    end = (place // width) * width + size[place // width]
    to = next_smaller(key, place, end)
    group = group_ranks(key, place, to - place)
    row = np.full(rows * width + 1, -1, np.int64)
    row[place] = np.arange(len(place))
    asked = row[starts]
    rank = np.zeros(len(asked), np.int64)
    tied = _refine(rank, np.arange(len(asked)), group[asked])
    follow = to[asked]
    while True:
        # Members of a rank have met the same groups, so they have come equally far.
        among = tied[follow[tied] - place[asked[tied]] < depth]
        if not len(among):
            break
        nxt = follow[among]
        over = nxt >= end[asked[among]]  # the end of a string comes before all groups
        there = row[np.where(over, place[asked[among]], nxt)]
        follow[among] = np.where(over, place[asked[among]] + depth, to[there])
        tied = _refine(rank, among, np.where(over, -1, group[there]))
    order = np.argsort(rank, kind="stable")
    sorted_ = place[asked[order]]
    return sorted_, agree(key, sorted_, end[asked[order]], depth)


def agree(key: np.ndarray, sorted_: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix begins with the same ``depth`` bytes as the one before it."""
    out = np.zeros(len(sorted_), bool)
    a, b = sorted_[:-1], sorted_[1:]
    now = np.flatnonzero((a + depth <= end[:-1]) & (b + depth <= end[1:]))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        now = now[key[a[now] + at] == key[b[now] + at]]
    out[now + 1] = True
    return out
