"""Periodic runs of words: stretches that repeat with a period several times over, found by the linear tandem-repeat
method of Gusfield and Stoye (squares.py).

Words are what white space separates (`[^\\x20\\x09-\\x0D]+`). A run of at least `exponent` periods and `least` words
consists of shingles that occur three times in it; words of a text that lie in no shingle occurring three times in it
cannot stand in a run, and are left out before. What remains of many texts is searched together, numbers that occur
once between the pieces.

Cases: a null or empty text, or one of white space, has no word and no run. Very long texts are searched whole, memory
following their periodic part. Rows that repeat are each searched. Extra columns of whatever names are carried through;
new columns get names that the input lacks. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_limits, fresh
from .squares import runs_of

#: Words searched together (a longer text is searched alone).
TOGETHER = 1 << 18
RUN = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_size(least: int, exponent: int) -> int:
    """So many words, at most three, that each shingle inside a run recurs in it three times at least."""
    # A run has max(least, exponent * q) - m + 1 of them, and each q further on is the same again.
    return max((m for m in (1, 2, 3) if exponent >= 3 and max(least, exponent) - m + 1 >= 3 and 2 * exponent - m + 1 >= 6), default=0)


def pieces_of(ids: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Whether each word may stand in a run: it lies in a shingle that occurs three times in its text."""
    n = len(ids)
    if not size or n < size:
        return np.ones(n, bool)
    key = doc.astype(np.uint64) * MIX[2]
    for k in range(size):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = ids[k:]
        key = (key ^ shifted) * MIX[0]
        key ^= key >> np.uint64(29)
    inside = np.zeros(n, bool)
    inside[: n - size + 1] = doc[: n - size + 1] == doc[size - 1 :]
    at = np.flatnonzero(inside)
    _, number, times = np.unique(key[at], return_inverse=True, return_counts=True)  # equal keys of unlike shingles keep too much
    often = at[times[number] >= 3]
    out = np.zeros(n + 1, np.int64)
    np.add.at(out, often, 1)
    np.add.at(out, often + size, -1)
    return np.cumsum(out)[:n] > 0


def runs_in(texts: list[list[bytes]], least: int, exponent: int) -> list[np.ndarray]:
    """For the words of each text its runs (start, length, period) of at least that many words and periods."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), size)
    number = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(size.sum()))
    keep = np.concatenate(([False], pieces_of(ids, doc, shingle_size(least, exponent)), [False]))
    same = np.concatenate(([False], doc[1:] == doc[:-1], [False]))  # with the word before
    begin = np.flatnonzero(keep[1:-1] & ~(keep[:-2] & same[:-1]))
    end = np.flatnonzero(keep[1:-1] & ~(keep[2:] & same[1:])) + 1
    long = end - begin >= least
    begin, end = begin[long], end[long]
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(begin):
        return out
    # Pieces one after another, a number of its own after each.
    length = end - begin + 1
    starts = np.cumsum(length) - length
    at = np.repeat(begin - starts, length) + np.arange(int(length.sum()))
    last = starts + length - 1
    s = ids[np.minimum(at, len(ids) - 1)]
    s[last] = len(number) + np.arange(len(last))
    start, words, period = runs_of(s)
    ok = words >= np.maximum(least, exponent * period)
    start, words, period = at[start[ok]], words[ok], period[ok]
    owner = doc[start]
    for d in np.unique(owner).tolist():
        mine = owner == d
        out[d] = np.stack((start[mine] - first[d], words[mine], period[mine]), 1)
    return out


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a run after its first period."""
    out = np.zeros(n + 1, np.int64)
    np.add.at(out, runs[:, 0] + runs[:, 2], 1)
    np.add.at(out, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(out)[:n] > 0


def _groups(texts: list[bytes | None]):
    """Words of texts, in groups of about TOGETHER words."""
    held, n = [], 0
    for t in texts:
        held.append((t or b"").split())
        n += len(held[-1])
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 6, exponent: int = 4) -> tuple[DataFrame, dict[str, str]]:
    """docs with two new columns, named by the returned dict: runs (an array of start, length, period in words, by start
    and period) and collapsed (the text's words, joined by a space, without what repeats: each run's first period stays)."""
    arrow_limits(docs.sparkSession)
    names = {x: fresh(docs, x) for x in ("runs", "collapsed")}
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["runs"], RUN), T.StructField(names["collapsed"], T.StringType())])
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            runs, collapsed = [], []
            for texts in _groups(b.column(at).cast(pa.binary()).to_pylist()):
                for words, found in zip(texts, runs_in(texts, least, exponent)):
                    if len(found):
                        gone = dropped(found, len(words)).tolist()
                        words = [w for w, g in zip(words, gone) if not g]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found.tolist()])
                    collapsed.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, kind), pa.array(collapsed, pa.string())], schema.names)

    return docs.mapInArrow(run, schema), names
