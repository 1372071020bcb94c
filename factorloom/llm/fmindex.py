"""An FM-index over word numbers, with its ranks in a wavelet matrix and sampled suffix positions. Plain numpy."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often c occurs before i, for arrays of c and i."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels, self.zeros, self.ones = max(1, int(top).bit_length()), [], []
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin, end = np.zeros(len(i), np.int64), i.astype(np.int64)
        for k in range(self.levels):
            one, ones = (c >> (self.levels - 1 - k)) & 1 == 1, self.ones[k]
            b, e = ones[begin], ones[end]
            begin, end = np.where(one, self.zeros[k] + b, begin - b), np.where(one, self.zeros[k] + e, end - e)
        return end - begin


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; every 0 is a separator of its own, below all words, in text order."""
    n = len(seq)
    stops = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(stops)
    rank[stops] = np.arange(len(stops))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        dense = np.concatenate(([0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])))
        rank[order] = dense
        if dense[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Over a sequence of numbers 1..top in which each run ends with the separator 0."""

    def __init__(self, seq: np.ndarray, top: int, every: int = 8):
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        counts = np.bincount(seq, minlength=top + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.ranks = WaveletMatrix(self.bwt, top)
        # A run's first position is sampled too, so that no walk crosses a separator.
        sampled = (sa % every == 0) | (self.bwt == 0)
        self.sampled, self.sample_no, self.samples = sampled, np.cumsum(sampled) - 1, sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of patterns of one length, from the last symbol to the first."""
        n = len(patterns)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        alive = np.arange(n)
        for k in reversed(range(patterns.shape[1])):
            c = patterns[alive, k]
            a, b = self.before[c] + self.ranks.rank(c, lo[alive]), self.before[c] + self.ranks.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix rows: walk back to a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            r = rows[open_]
            c = self.bwt[r]
            rows[open_] = self.before[c] + self.ranks.rank(c, r)
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.samples[self.sample_no[rows]] + steps
