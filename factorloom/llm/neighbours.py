"""Nearest neighbours by inner product: an inverted multi-index over two halves of each vector.

- Equal vectors are one entry, with the smallest of their ids: so many as may be asked for, and one more.
- Each half of the vectors has centroids of its own, fitted on a bounded sample (SAMPLE vectors, those that hash lowest).
  A pair of centroids is a cell; every entry lies in one.
- A query takes the cells in the order of the summed inner products of its halves with their centroids, from a heap,
  until the cells hold as many entries as were needed for the wanted recall. That number is measured: for TRIED queries
  (those that hash lowest) all entries are searched, and it is the quantile of what their true neighbours needed. With
  recall=None all cells are taken, and the result is exact.
- Cells that follow one another share a shard of bounded size, a cell larger than that is dealt over several, and a
  shard that many queries visit is copied. A query goes once to each shard, with the cells that it visits there, whose
  entries are scored in double precision.

Cases: vectors that are null, zero or hold nulls or other than finite numbers take no part, nor do rows of a null id or
vectors of another length than most have. Rows that repeat an id and its vector count once; one id with several vectors is
several candidates. Equal scores go by the smaller id. A query never finds its own id. Extra columns, whatever their names,
are left out. No query, or no vector: an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, forget, materialize, sample_by_hash

#: Vectors that the centroids are fitted on, queries that the recall is measured with, centroids of a half at most.
SAMPLE, TRIED, CENTROIDS = 20_000, 256, 256
#: Entries of a shard, least and most; queries of a copy of a shard.
SHARD, QUERIES = (512, 1 << 16), 1 << 15
KEY = ["h1", "h2"]


def clean(rows: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """id, vec (doubles), h1, h2 (128 bits of the vector) of the rows that take part."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    out = rows.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where("id is not null and vec is not null")
    out = out.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    if length is not None:
        out = out.where(F.size("vec") == length)
    return out.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))


def usual_length(rows: DataFrame, id_col: str, vector_col: str) -> int | None:
    """The length that most vectors have (of equals, the greatest)."""
    found = clean(rows, id_col, vector_col).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.n if found else None


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """h1, h2, vec and the smallest ids (at most so many) of each distinct vector.

    A vector of any number of copies is dealt by its ids first, and a rank within each part is cut before the shuffle."""
    part = Window.partitionBy(*KEY, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("n", F.dense_rank().over(part)).where(F.col("n") <= most)
    return few.groupBy(*KEY).agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids"))


# --- centroids and cells -------------------------------------------------------------------------------------------------


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, passes: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(passes):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


class Halves:
    """The centroids of both halves."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 0):
        rng = np.random.default_rng([seed, 53])
        self.at = max(1, sample.shape[1] // 2)
        parts = sample[:, : self.at], sample[:, self.at :]
        self.c = [lloyd(p, k, rng) if p.shape[1] else np.zeros((k, 0)) for p in parts]
        self.k = k

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.at], self.c[0]) * self.k + nearest(x[:, self.at :], self.c[1])

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.at] @ self.c[0].T, x[:, self.at :] @ self.c[1].T


def in_order(a: np.ndarray, b: np.ndarray):
    """Pairs (row of a, row of b) by falling a + b, from a heap over the two sorted lists."""
    first, second = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    x, y = (-a[first]).tolist(), (-b[second]).tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield first[i], second[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def visited(a: np.ndarray, b: np.ndarray, sizes: list[int], wanted: float) -> list[int]:
    """The cells with entries that a query takes: until they hold so many."""
    out, have = [], 0
    for i, j in in_order(a, b):
        if have >= wanted:
            break
        cell = i * len(b) + j
        if sizes[cell]:
            out.append(cell)
            have += sizes[cell]
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, from an Arrow column of lists without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each added up in one order whatever stands beside it."""
    return np.add.reduce(np.ascontiguousarray(vectors * query), axis=1)


def best_of(scores: np.ndarray, most: int) -> np.ndarray:
    """Which are the greatest: so many, and all that equal the last of them or lie within rounding of it."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    return np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))


# --- the measured number of entries ------------------------------------------------------------------------------------------


def entries_needed(entries: DataFrame, tried: list, halves: Halves, sizes: list[int], k: int, recall: float) -> float:
    """So many entries hold the given share of the true neighbours of the tried queries (rows of h1, h2, vec)."""
    spark = entries.sparkSession
    sent = spark.sparkContext.broadcast(([(q.h1, q.h2) for q in tried], np.array([q.vec for q in tried])))

    def run(batches):
        keys, queries = sent.value
        top = [[] for _ in keys]
        for b in batches:
            x, cell, own = matrix(b.column(0)), b.column(1).to_numpy(), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            for n, scores in enumerate(queries @ x.T):
                found = [(-float(scores[m]), int(cell[m])) for m in best_of(scores, k + 1).tolist() if own[m] != keys[n]]
                top[n] = sorted(top[n] + found)[:k]
        out = [(n, s, c) for n, rows in enumerate(top) for s, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[m] for r in out], t) for m, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], ["n", "s", "cell"])

    rows = entries.select("vec", "cell", *KEY).mapInArrow(run, "n int, s double, cell int")
    for salt in (F.pmod(F.spark_partition_id(), F.lit(32)), F.lit(0)):
        rows = rows.groupBy("n", salt.alias("salt")).agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "cell"))), 1, k).alias("r")).select("n", F.explode("r").alias("r")).select("n", "r.s", "r.cell")
    cells: dict[int, list[int]] = {}
    for r in rows.collect():  # k rows a tried query
        cells.setdefault(r.n, []).append(r.cell)
    sent.destroy()
    needed = []
    for n, (a, b) in enumerate(zip(*halves.scores(np.array([q.vec for q in tried])))):
        left, have = list(cells.get(n, [])), 0
        for i, j in in_order(a, b):
            if not left:
                break
            cell = i * halves.k + j
            have += sizes[cell]
            needed += [have] * left.count(cell)
            left = [c for c in left if c != cell]
    return float(np.quantile(needed, recall, method="higher")) if needed else float("inf")


# --- search --------------------------------------------------------------------------------------------------------------------


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float | None = 0.96, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0, centroids: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of vectors found for each row of queries (id and vector
    in columns of the same names). recall: the share of true neighbours aimed at; None searches every cell."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    length = usual_length(vectors, id_col, vector_col)
    if length is None:
        return empty
    classes = materialize(spark, entries_of(clean(vectors, id_col, vector_col, length), k + 1))
    asked = materialize(spark, clean(queries, id_col, vector_col, length))
    wants = materialize(spark, asked.groupBy(*KEY).agg(F.first("vec").alias("vec")))
    n = classes.count()
    size = min(n, centroids or CENTROIDS, max(1, round((n / 4) ** 0.5)))
    sample = sample_by_hash(classes.select("h1", "vec"), "h1", SAMPLE).toArrow()
    halves = Halves(matrix(sample.column("vec").combine_chunks()), min(size, sample.num_rows), seed)
    sent = spark.sparkContext.broadcast(halves)

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.cells(matrix(b.column(2))).astype(np.int32))], [*b.schema.names, "cell"])

    entries = materialize(spark, classes.select(*KEY, "vec", "ids").mapInArrow(assign, "h1 bigint, h2 bigint, vec array<double>, ids array<bigint>, cell int"))
    forget(spark, classes)
    sizes = np.zeros(halves.k**2, np.int64)
    for r in entries.groupBy("cell").count().collect():  # CENTROIDS squared at most
        sizes[r.cell] = r["count"]
    wanted = float("inf")
    if recall is not None:
        tried = sample_by_hash(wants.select(*KEY, "vec"), "h1", TRIED).collect()
        wanted = entries_needed(entries, tried, halves, sizes.tolist(), k, recall) if tried else 0.0
    top = _scored(entries, wants, halves, sizes, wanted, k)
    top = materialize(spark, top)  # a table of its own, so that the join can split a vector that many queries have
    forget(spark, entries, wants)
    own = asked.select("id", *KEY).distinct().join(top, KEY)
    ranked = own.select("id", F.posexplode(F.slice(F.filter("best", lambda r: r.id != F.col("id")), 1, k)).alias("at", "r"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("r.id").alias("vec_id"), (-F.col("r.s")).alias("score"))


def _scored(entries: DataFrame, wants: DataFrame, halves: Halves, sizes: np.ndarray, wanted: float, k: int) -> DataFrame:
    """h1, h2 of each distinct query vector with best: an array of (s, the score's opposite, and id), k + 1 at most."""
    spark = entries.sparkSession
    n = int(sizes.sum())
    room = min(SHARD[1], max(SHARD[0], n // 32))
    before = np.cumsum(sizes) - sizes
    first, parts = before // room, np.maximum((before + sizes - 1) // room - before // room + 1, 1)
    layout = [(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(sizes)]
    layout = spark.createDataFrame(layout, "cell int, first int, parts int")
    rows = entries.join(F.broadcast(layout), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("h2"), F.col("parts"))).cast("int"))
    sent = spark.sparkContext.broadcast((halves, sizes.tolist(), first.tolist(), parts.tolist()))

    def traverse(batches):
        halves, sizes, first, parts = sent.value
        for b in batches:
            which, shards, cells = [], [], []
            for m, (x, y) in enumerate(zip(*halves.scores(matrix(b.column(2))))):
                by: dict[int, list[int]] = {}
                for c in visited(x, y, sizes, wanted):
                    for s in range(first[c], first[c] + parts[c]):
                        by.setdefault(s, []).append(c)
                for s, cs in by.items():
                    which.append(m)
                    shards.append(s)
                    cells.append(cs)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(3)), pa.array(shards, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["h1", "h2", "vec", "shard", "cells"])

    spread = wants.select(*KEY, "vec").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small table, much work
    visits = materialize(spark, spread.mapInArrow(traverse, "h1 bigint, h2 bigint, vec array<double>, shard int, cells array<int>"))
    copies = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("of"))
    copies = materialize(spark, copies)  # one row a shard
    rows = rows.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    asks = visits.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("h1"), F.col("of")).cast("int"))
    nothing = F.lit(None)
    both = rows.select("shard", "copy", F.lit(0).alias("kind"), "vec", "ids", "cell", nothing.cast("array<int>").alias("cells"), *KEY).union(
        asks.select("shard", "copy", F.lit(1).alias("kind"), "vec", nothing.cast("array<bigint>").alias("ids"), nothing.cast("int").alias("cell"), "cells", *KEY))
    both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "cell")
    found = both.mapInArrow(_rerank(k + 1), "shard int, h1 bigint, h2 bigint, best array<struct<s: double, id: bigint>>")
    groups = max(1, int((n / room) ** 0.5))
    for salt in (F.pmod("shard", F.lit(groups)), F.lit(0)):
        found = found.groupBy(*KEY, salt.alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    return found.select(*KEY, "best")


def _rerank(most: int):
    """Batches sorted by shard and copy, entries before queries: for each query its best rows among the cells it visits."""

    def run(batches):
        now, held, index = None, [], None
        for b in batches:
            shard, copy, kind = (b.column(c).to_numpy() for c in range(3))
            key = shard.astype(np.int64) << 32 | copy
            cut = np.flatnonzero(np.diff(key) | np.diff(kind)) + 1
            out = []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                part = b.slice(lo, hi - lo)
                if key[lo] != now:
                    now, held, index = key[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if index is None and held:
                    index, held = Shard(held), []
                if index is not None:
                    for query, cells, h1, h2 in zip(matrix(part.column(3)), part.column(6).to_pylist(), part.column(7).to_pylist(), part.column(8).to_pylist()):
                        out.append((int(shard[lo]), h1, h2, index.best(query, np.array(cells), most)))
            pair = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pair))], ["shard", "h1", "h2", "best"])

    return run


class Shard:
    """The entries of a shard, by cell."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.x = matrix(table.column(3).combine_chunks())
        ids = table.column(4).combine_chunks()
        self.ids, self.counts = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
        self.at = np.cumsum(self.counts) - self.counts
        self.cells, self.lo = np.unique(table.column(5).to_numpy(), return_index=True)  # sorted by cell
        self.hi = np.append(self.lo[1:], len(self.x))

    def best(self, query: np.ndarray, cells: np.ndarray, most: int) -> list[dict]:
        c = np.searchsorted(self.cells, cells)
        ok = (c < len(self.cells)) & (self.cells[np.minimum(c, len(self.cells) - 1)] == cells)
        c = c[ok]
        n = self.hi[c] - self.lo[c]
        rows = np.repeat(self.lo[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rows = rows[best_of(self.x[rows] @ query, most)]
        score, n = exact(self.x[rows], query), self.counts[rows]
        ids = self.ids[np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        score = np.repeat(score, n)
        by = np.lexsort((ids, -score))[:most]
        return [{"s": -s, "id": m} for s, m in zip(score[by].tolist(), ids[by].tolist())]


def every(n: int, id_col: str = "vec_id") -> Column:
    """Rows whose id is divisible by n."""
    return F.col(id_col) % n == 0
