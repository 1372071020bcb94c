"""Toxicity by a counterfactual-regularised classifier.

A sparse logistic regression on the presence of words and word beginnings. Each labelled sentence that names an
identity group is repeated with the term swapped for others of its kind, and the squared change of the score is
penalised, so that terms of groups carry no weight of their own and neutral mentions are left alone. The L1 term
keeps neutral words at exactly zero, so that a document's score doesn't drift with its length.

Cases: a null or empty text gets the score of no evidence; rows with a null id or label are never learned from;
of several labels of one document the greatest counts; with no labelled rows, or labels of one kind only, the
score is the smoothed share of toxic labels. Whole texts are read, however long; the bound on what is learned from is
that on labelled documents (max_rows). Repeated rows get equal scores; an empty table gives an empty
table. Extra columns are carried through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, fresh, sample_by_hash

WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are features; words in a task's table.
BEGINNINGS, TABLE_WORDS = (4, 5, 6), 300_000
#: Terms of identity groups that stand for one another in counterfactual sentences.
GROUPS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("black", "white", "asian", "african", "latino", "hispanic", "arab", "indian"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)
SWAPS = {w: tuple(x for x in group if x != w) for group in GROUPS for w in group}


def features_of(word: str) -> list[int]:
    """Of a lower-cased word: the word, and its beginnings if it goes on after them."""
    return [xxhash.xxh32_intdigest("w" + word)] + [xxhash.xxh32_intdigest(f"{n}" + word[:n]) for n in BEGINNINGS if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Weights by feature, the intercept."""

    intercept: float
    weights: dict[int, float] = field(default_factory=dict)
    table: dict[str, tuple] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        hits: set[int] = set()
        for w in words_of(text):
            own = self.table.get(w)
            if own is None:
                if len(self.table) >= TABLE_WORDS:
                    self.table.clear()
                own = self.table[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                hits.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + sum(self.weights[f] for f in hits), -50, 50))))


def counterfactuals(words: set[str]) -> list[tuple[set[int], set[int]]]:
    """For each identity term among the words: (features lost, features gained) by each swap."""
    out, terms = [], words & SWAPS.keys()
    if not terms:
        return out
    times = Counter(f for x in words for f in features_of(x))
    for w in sorted(terms):
        own = features_of(w)
        lost = {f for f in own if times[f] == 1}
        for other in SWAPS[w]:
            if other not in words:
                out.append((lost, {f for f in features_of(other) if not times[f] or f in lost}))
    return out


def fit(rows: list[tuple[int, np.ndarray]], swaps: list[tuple[list[int], list[int]]], l1: float = 3e-5, penalty: float = 5.0, steps: int = 600, least_documents: int = 3, least_z: float = 3.0) -> Model:
    """rows: (label, distinct features); swaps: (features lost, features gained) of counterfactual sentences."""
    n = len(rows)
    y = np.array([r[0] for r in rows], np.float64)
    share = float((y.sum() + 0.5) / (n + 1))
    prior = Model(float(np.log(share / (1 - share))))
    if not n or y.min() == y.max():
        return prior
    row = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    names, col = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    count, toxic = np.bincount(col), np.bincount(col, weights=y[row])
    # Screening: features whose share of toxic documents is far from the whole sample's.
    z = np.abs(toxic - count * y.mean()) / np.sqrt(count * y.mean() * (1 - y.mean()))
    z[(count < least_documents)] = 0
    used = np.flatnonzero(z >= least_z)
    if not len(used):
        return prior
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    number = {int(f): k for k, f in enumerate(names[used])}
    pr, pc, pv, k = [], [], [], 0
    for lost, gained in swaps:
        own = [(number[f], s) for fs, s in ((lost, 1.0), (gained, -1.0)) for f in fs if f in number]
        pr += [k] * len(own)
        pc += [c for c, _ in own]
        pv += [s for _, s in own]
        k += bool(own)
    pr, pc, pv = np.array(pr, np.int64), np.array(pc, np.int64), np.array(pv, np.float64)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # both labels weigh the same
    w, b, v, vb, t = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0, 1.0

    def gradient(w, b):
        s = np.bincount(row, w[col], n) + b
        d = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y) * weight
        g = np.bincount(col, d[row], len(w))
        if k:
            change = np.bincount(pr, w[pc] * pv, k)
            g = g + 2 * penalty / k * np.bincount(pc, change[pr] * pv, len(w))
        return g, d.sum()

    # The largest curvature, by power iteration, gives the step.
    u = np.ones(len(used)) / np.sqrt(len(used))
    for _ in range(15):
        hv = np.bincount(col, (0.25 * weight * np.bincount(row, u[col], n))[row], len(u))
        if k:
            hv = hv + 2 * penalty / k * np.bincount(pc, np.bincount(pr, u[pc] * pv, k)[pr] * pv, len(u))
        top = float(np.linalg.norm(hv)) or 1.0
        u = hv / top
    rate = 1 / (1.2 * top + 0.25)
    for _ in range(steps):  # accelerated proximal gradient
        g, gb = gradient(v, vb)
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        nb = vb - rate * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b), {int(names[used[k]]): float(w[k]) for k in on})


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000, **how) -> Model:
    """A model from at most max_rows labelled documents (by a hash of the id) where learn, a condition on the labels' id, holds.

    Features are made on the executors; the driver gets numbers only."""
    spark = docs.sparkSession
    arrow_limits(spark)
    chosen = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = sample_by_hash(chosen.select(F.col(id_col).alias("id"), "label"), "id", max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def run(batches):
        for b in batches:
            made, lost, gained = [], [], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                made.append(sorted({f for w in words for f in features_of(w)}))
                pairs = counterfactuals(words)
                lost.append([sorted(x) for x, _ in pairs])
                gained.append([sorted(x) for _, x in pairs])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, ints), pa.array(lost, pa.list_(ints)), pa.array(gained, pa.list_(ints))], ["id", "label", "features", "lost", "gained"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = rows.mapInArrow(run, f"id {kind}, label int, features array<bigint>, lost array<array<bigint>>, gained array<array<bigint>>").toArrow()
    table = table.sort_by([("id", "ascending"), ("label", "ascending")])
    examples = [(y, f.values.to_numpy()) for y, f in zip(table["label"].to_pylist(), table["features"])]
    swaps = [p for a, b in zip(table["lost"].to_pylist(), table["gained"].to_pylist()) for p in zip(a, b)]
    return fit(examples, swaps, **how)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with the score, 0 to 1, in a new column whose name is returned."""
    spark = docs.sparkSession
    arrow_limits(spark)
    name, at, sent = fresh(docs, "score"), docs.columns.index(text_col), spark.sparkContext.broadcast((model.intercept, model.weights))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        own = Model(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.score(t) for t in b.column(at).to_pylist()], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema), name


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
