"""An FM-index of a sequence of word ids, in numpy, for patterns of few words.

The sequence holds ids 1 .. size of words and 0 as the end of a piece; no pattern
has a 0. The suffixes are sorted by their first two symbols only: a pattern's
suffixes are then together as long as the pattern has two words, and a step from
an interval of such patterns counts exactly how often each symbol stands next to
it. The reversed sequence has an index of its own; an interval in one and the
interval of the reversed pattern in the other are kept together (bidirectional
extension), so patterns can grow at either end. All intervals of a level are
extended in one pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Intervals(NamedTuple):
    words: np.ndarray     # one row a pattern
    count: np.ndarray
    lo: np.ndarray        # of its interval among the suffixes of the sequence
    back: np.ndarray      # of the reversed pattern's among those of the reversed sequence


def _bwt(seq: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol before each sorted suffix, place of the suffix that begins with that symbol)."""
    order = np.argsort(seq * np.int64(size + 1) + np.roll(seq, -1), kind="stable")
    bwt = seq[order - 1].astype(np.int32)
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(len(seq), np.int32)
    step[by_symbol] = np.arange(len(seq), dtype=np.int32)
    return bwt, step


class FmIndex:
    def __init__(self, seq: np.ndarray, size: int):
        """``seq`` ends with a 0."""
        seq = np.asarray(seq, np.int64)
        if not len(seq) or seq[-1]:
            raise ValueError("the sequence must end with 0")
        self.size = size
        self.counts = np.bincount(seq, minlength=size + 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        self.left = _bwt(seq, size)
        self.right = _bwt(np.concatenate([seq[-2::-1], seq[-1:]]), size)

    def words(self) -> Intervals:
        w = np.flatnonzero(self.counts[1:]) + 1
        return Intervals(w[:, None], self.counts[w], self.first[w], self.first[w])

    def _extend(self, index: tuple[np.ndarray, np.ndarray], lo: np.ndarray, count: np.ndarray):
        """For each interval and symbol next to it: (interval, symbol, count, new
        lo in this index, symbols of the interval that are smaller)."""
        bwt, step = index
        starts = np.concatenate([[0], np.cumsum(count)])[:-1]
        which = np.repeat(np.arange(len(lo), dtype=np.int64), count)
        place = np.arange(len(which)) + (lo - starts)[which]
        key = which * (self.size + 1) + bwt[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(begin, len(key)))
        of, symbol = np.divmod(key[begin], self.size + 1)
        keep = symbol > 0
        begin, total, of, symbol = begin[keep], total[keep], of[keep], symbol[keep]
        return of, symbol, total, step[place[order[begin]]].astype(np.int64), begin - starts[of]

    def extend_right(self, x: Intervals) -> Intervals:
        of, symbol, total, back, smaller = self._extend(self.right, x.back, x.count)
        return Intervals(np.column_stack([x.words[of], symbol]), total, x.lo[of] + smaller, back)

    def extend_left(self, x: Intervals) -> Intervals:
        of, symbol, total, lo, smaller = self._extend(self.left, x.lo, x.count)
        return Intervals(np.column_stack([symbol, x.words[of]]), total, lo, x.back[of] + smaller)
