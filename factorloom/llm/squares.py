"""All runs of a sequence of numbers by the linear method of Gusfield and Stoye, on numpy arrays; nothing here knows Spark.

- Names of all substrings of a power-of-two length (Karp, Miller, Rosenberg) give the suffix array and the common
  extension of any two places.
- The blocks of the Lempel-Ziv factorisation, and common extensions from each block's ends, give for each block and
  period the leftmost square: a set that covers the leftmost place of every square.
- In the suffix tree, each such square is a place on an edge. Its suffix link and one letter more is its rotation: walks
  along them, until they leave the tree or meet a place that is marked, complete the vocabulary of squares.
- The leaves below a place are the square's occurrences; those of one period that follow one another are a run.

Only squares of primitive roots are followed: rotations keep that, and their occurrences are n log n at most. Memory is
some hundred bytes a number times the logarithm of the longest repeat.
"""

from __future__ import annotations

import functools

import numpy as np


class Names:
    """Names of s[i : i + 2**t]: equal if and only if the substrings are. The last number of s must be unique."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        name = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.levels = [name.astype(np.int32)]
        while int(name.max()) + 1 < n:
            width = 1 << (len(self.levels) - 1)
            after = np.full(n, 0, np.int64)
            after[: max(n - width, 0)] = name[width:] + 1
            name = np.unique(name * (n + 1) + after, return_inverse=True)[1]
            self.levels.append(name.astype(np.int32))
        self.rank = name
        self.order = np.empty(n, np.int64)  # the suffix array
        self.order[name] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension from places i and j (not equal) to the right."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[t][i] == self.levels[t][j]).astype(np.int64) << t
            i += step
            j += step
            out += step
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same to the left, with places i and j themselves."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            x, y = i - (1 << t) + 1, j - (1 << t) + 1
            inside = np.minimum(x, y) >= 0
            step = (inside & (self.levels[t][np.where(inside, x, 0)] == self.levels[t][np.where(inside, y, 0)])).astype(np.int64) << t
            i -= step
            j -= step
            out += step
        return out


class Least:
    """Where values fall below a bound, to the right or left of a place."""

    def __init__(self, x: np.ndarray):
        self.n, self.tables = len(x), [x.astype(np.int32)]
        while 2 << (len(self.tables) - 1) <= self.n:
            last, width = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-width], last[width:]))

    def following(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First place from `at` on whose value is below the bound (n if none)."""
        at = at.copy()
        for t in range(len(self.tables) - 1, -1, -1):
            x = self.tables[t]
            inside = at < len(x)
            at += (inside & (x[np.where(inside, at, 0)] >= bound)).astype(np.int64) << t
        return at

    def preceding(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Last place up to `at` whose value is below the bound (-1 if none)."""
        at = at.copy()
        for t in range(len(self.tables) - 1, -1, -1):
            first = at - (1 << t) + 1
            inside = first >= 0
            at -= (inside & (self.tables[t][np.where(inside, first, 0)] >= bound)).astype(np.int64) << t
        return at


@functools.lru_cache(1 << 16)
def primes_of(k: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= k:
        if k % p == 0:
            out.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return (*out, k) if k > 1 else tuple(out)


def blocks_of(names: Names) -> np.ndarray:
    """First places of the Lempel-Ziv blocks: each the longest prefix of what is left that begins earlier too, or one number."""
    here, rank = np.arange(names.n), names.rank
    least = Least(names.order)
    longest = np.zeros(names.n, np.int64)
    for other in (least.preceding(rank, here), least.following(rank, here)):
        ok = np.flatnonzero((other >= 0) & (other < names.n))
        longest[ok] = np.maximum(longest[ok], names.ahead(here[ok], names.order[other[ok]]))
    step, at, out = np.maximum(longest, 1).tolist(), 0, []
    while at < names.n:
        out.append(at)
        at += step[at]
    return np.array(out)


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which of them, and 1, 2, ... n of each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + 1


def leftmost(names: Names, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares that cover the leftmost place of each square of a primitive root."""
    ends = np.append(starts[1:], names.n)
    size, beyond = ends - starts, np.append(ends[1:], names.n)
    # The first number of the next block lies in the right half, and the square begins in this block.
    b, k = _counted(np.where(ends < names.n, size, 0))
    right = ends[b]
    q = right - k
    k1, k2 = names.ahead(right, q), names.behind(right - 1, q - 1)
    ok = (k1 > 0) & (k1 + k2 >= k)
    found = [(np.maximum(q - k2, q - k + 1)[ok], k[ok])]
    # The first number of this block lies in the left half, and does not begin the square.
    b, k = _counted(np.where(starts > 0, np.minimum(beyond - starts, names.n - 1 - starts), 0))
    left, stop = starts[b], ends[b]
    k1, k2 = names.ahead(left, left + k), names.behind(left - 1, left + k - 1)
    first = np.maximum(left - k2, left - k + 1)
    ok = (k1 > 0) & (k2 > 0) & (k1 + k2 >= k) & (first + k <= stop)
    found.append((first[ok], k[ok]))
    at, period = (np.concatenate(x) for x in zip(*found))
    whole = [(n, k // p) for n, k in enumerate(period.tolist()) for p in primes_of(k)]
    if whole:
        n, part = np.array(whole).T
        primitive = np.ones(len(at), bool)
        primitive[n[names.ahead(at[n], at[n] + part) >= period[n] - part]] = False
        at, period = at[primitive], period[primitive]
    return at, period


class Tree:
    """The suffix tree over the suffix array: leaf r is r, inner nodes follow from n on."""

    def __init__(self, s: np.ndarray, names: Names):
        n, order, rank = names.n, names.order, names.rank
        common = np.full(n + 1, -1, np.int64)  # of each suffix with the one before it in order
        common[1:n] = names.ahead(order[:-1], order[1:])
        least = self.least = Least(common)
        x = np.arange(1, n)
        lo, hi = least.preceding(x - 1, common[x]), least.following(x + 1, common[x])
        _, first, number = np.unique(lo * (n + 2) + hi, return_index=True, return_inverse=True)
        owner = np.concatenate(([-1], number + n, [-1]))
        at = x[first]
        self.n, self.order = n, order
        self.lo, self.hi = np.concatenate((np.arange(n), lo[first])), np.concatenate((np.arange(n) + 1, hi[first]))
        self.depth = np.concatenate((n - order, common[at]))
        left, right = common[self.lo], common[self.hi]
        self.parent = owner[np.where(left >= right, self.lo, self.hi)]
        self.root = int(np.flatnonzero(self.parent < 0)[0])
        self.link = np.full(len(self.lo), self.root)
        deep = common[at] > 0
        a = at[deep]
        self.link[n:][deep] = owner[least.following(rank[order[a - 1] + 1] + 1, common[a])]
        self.place = order[self.lo]  # an occurrence of each node's string
        rest = np.flatnonzero(self.parent >= 0)
        self.letters = int(s.max()) + 1
        above = self.parent[rest]
        keys = above * self.letters + s[self.place[rest] + self.depth[above]]
        self.child = dict(zip(keys.tolist(), rest.tolist()))
        self.s = s

    def places(self, at: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The node at or below the end of each s[at : at + length]."""
        lo, hi = self.least.preceding(rank[at], length), self.least.following(rank[at] + 1, length)
        inner = np.flatnonzero(hi - lo > 1)
        out = rank[at].copy()
        keys = self.lo[self.n :] * (self.n + 2) + self.hi[self.n :]  # ascending: they come from unique()
        out[inner] = self.n + np.searchsorted(keys, lo[inner] * (self.n + 2) + hi[inner])
        return out

    def vocabulary(self, nodes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places (node, length) that rotations of the given ones lead to, with these."""
        s, parent, depth, link, place = (x.tolist() for x in (self.s, self.parent, self.depth, self.link, self.place))
        child, letters = self.child.get, self.letters
        begun = list(dict.fromkeys(zip(nodes.tolist(), length.tolist())))
        marked = set(begun)
        for node, size in begun:
            while True:
                first, text = s[place[node]], place[node] + 1
                u = link[parent[node]]
                while depth[u] < size - 1:
                    below = child(u * letters + s[text + depth[u]])
                    if depth[below] >= size:
                        break
                    u = below
                if depth[u] == size - 1:
                    node = child(u * letters + first)
                else:
                    node = below if s[place[below] + size - 1] == first else None
                if node is None or (node, size) in marked:
                    break
                marked.add((node, size))
        found = np.array(list(marked), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def runs_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of each run (length twice the period or more) of s, by start and period. The
    last number of s must be unique; those that end parts of s (and no run may cross) must be too."""
    none = np.zeros(0, np.int64)
    if len(s) < 3:
        return none, none, none
    s = np.unique(s, return_inverse=True)[1].astype(np.int64)
    names = Names(s)
    at, period = leftmost(names, blocks_of(names))
    if not len(at):
        return none, none, none
    tree = Tree(s, names)
    node, size = tree.vocabulary(tree.places(at, 2 * period, names.rank), 2 * period)
    which, number = _counted(tree.hi[node] - tree.lo[node])
    start, k = tree.order[tree.lo[node][which] + number - 1], (size // 2)[which]
    by = np.lexsort((start, k))
    start, k = start[by], k[by]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(start) != 1) | (np.diff(k) != 0))))
    last = np.append(new[1:], len(start)) - 1
    out = start[new], start[last] - start[new] + 2 * k[new], k[new]
    by = np.lexsort((out[2], out[0]))
    return tuple(x[by] for x in out)
