"""Numbered pieces of text with the token ids of each, kept flat, so that a batch is looked up by array operations."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

#: Characters remembered at most.
MAX_CHARS = 16 << 20


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; a run may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class PieceStore:
    """``learn`` gives the ids of new pieces, in their order; beyond ``limit`` pieces those met once are forgotten, or all."""

    def __init__(self, learn: Callable[[list], list], limit: int):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.chars = self.used = 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.flat = np.zeros(1 << 14, np.uint32)

    def forget(self) -> None:
        """Call between batches: numbers given out before are void afterwards."""
        if len(self.known) <= self.limit and self.chars <= MAX_CHARS:
            return
        often = [(p, k) for p, k in self.known.items() if self.uses[k] > 1]
        chars = sum(len(p) for p, _ in often)
        if len(often) > self.limit // 2 or chars > MAX_CHARS // 2:
            self.clear()
            return
        old = np.fromiter((k for _, k in often), np.int64, len(often))
        self.flat, self.lengths = self.ids(old), self.lengths[old]
        self.starts, self.uses = np.cumsum(self.lengths) - self.lengths, np.ones(len(old), np.int64)
        self.known, self.chars, self.used = {p: k for k, (p, _) in enumerate(often)}, chars, len(self.flat)

    def _room(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, 2 * len(old)), old.dtype)
            new[:len(old)] = old
            setattr(self, name, new)

    def number(self, pieces: list) -> np.ndarray:
        """The pieces' numbers; unknown ones are learnt first, each once."""
        known = self.known
        numbers = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            fresh = list(dict.fromkeys([pieces[k] for k in new]))
            ids = self.learn(fresh)
            at = len(known)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self._room("starts", at + len(fresh))
            self._room("lengths", at + len(fresh))
            self._room("uses", at + len(fresh))
            self.uses[at:at + len(fresh)] = 0
            self.starts[at:at + len(fresh)] = self.used + np.cumsum(count) - count
            self.lengths[at:at + len(fresh)] = count
            self._room("flat", self.used + int(count.sum()))
            self.flat[self.used:self.used + int(count.sum())] = [x for one in ids for x in one]
            self.used += int(count.sum())
            self.chars += sum(map(len, fresh))
            known.update(zip(fresh, range(at, at + len(fresh))))
            numbers[new] = [known[pieces[k]] for k in new]
        self.uses[:len(known)] += np.bincount(numbers, minlength=len(known))
        return numbers

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[numbers], self.lengths[numbers])]
