"""Ranked lexical search, score at a time over postings in order of impact.

Documents are counted once: the number of terms of each, and of the query terms that it holds how often. With the counts
over all documents known, each posting has an exact integer impact. A task takes its documents in blocks; a block's
postings are grouped by term and exact impact. For a query, groups are added to accumulators in falling order of impact
(a step takes the groups of all its terms between two bounds). The greatest impacts that are left bound what any document
can still gain; once no document beyond the candidates can reach the k-th score (of this block or of earlier ones), the
candidates' scores are completed from their own postings. Each task gives its best k for each query; these are merged by
salted groups.

Queries go to the tasks in blocks of bounded size, each one pass over the counted documents.

Terms are runs of digits, letters and bytes from 0x80 on; A-Z are lower-cased. The score of a document sums over a query's
terms, once each, w * ((1000000000 * tf) div (1000 * tf + 20 * m)), where w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and
m = 50 + (50 * n * N) div L.

Cases: a null or empty text has no term and is no document of the statistics. Rows that repeat an id are documents of their
own; a null id comes after all others of its score. Rows that repeat an item's id and text are one item; items of one id
and unlike texts are ranked each on its own. Items without terms find nothing. Very long texts are counted whole. Extra
columns, whatever their names, are left out. Empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, forget, materialize
from .decontaminate import words_of

#: Bytes of queries in a block; postings of a block of documents.
BLOCK_BYTES, POSTINGS = 4 << 20, 400_000
#: Documents that a task has, about: the groups that best rows are merged in are as many as the root of the tasks.
DOCUMENTS = 10_000
#: A step of the descent ends where impacts have fallen to this share of the last bound.
FALL = 0.7


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms (places in the list) and times: what each document with a term holds."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)

    def run(batches):
        number = {t: k for k, t in enumerate(sent.value)}
        get = number.get
        for b in batches:
            ids, n, ends, held, times = [], [], [0], [], []
            for k, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                if words:
                    ids.append(k)
                    n.append(len(words))
                    for w, c in Counter(words).items():
                        t = get(w)
                        if t is not None:
                            held.append(t)
                            times.append(c)
                    ends.append(len(held))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (held, times)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "times"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, n bigint, terms array<int>, times array<int>")


class Block:
    """Postings of some documents, by term and falling impact, and by document."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), counts)
        impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
        by = np.lexsort((-impact, terms))
        self.doc, self.impact, sorted_terms = doc[by], impact[by], terms[by]
        # Groups of one term and one exact impact.
        head = np.flatnonzero(np.concatenate(([True], (np.diff(sorted_terms) != 0) | (np.diff(self.impact) != 0)))) if len(by) else np.zeros(0, np.int64)
        self.head, self.value = np.append(head, len(by)), self.impact[head]
        self.first = np.searchsorted(sorted_terms[head], np.arange(len(weights) + 1))  # of each term among the groups
        # By document, for completion.
        self.begin = np.cumsum(counts) - counts
        self.counts, self.terms, self.own = counts, terms, impact

    def search(self, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions of documents, scores): among them all whose score is above 0 and of the k greatest here, unless it is below least."""
        lists = [(self.value[a:b], self.head[a : b + 1]) for a, b in zip(self.first[query], self.first[query + 1]) if a < b]
        lists = [x for x in lists if x[0][0] > 0]
        total = np.zeros(len(self.ids), np.int64)
        if not lists:
            return np.zeros(0, np.int64), total[:0]
        falling = [-v for v, _ in lists]
        done = [0] * len(lists)
        bound = max(int(v[0]) for v, _ in lists)
        while True:
            bound = int(bound * FALL)
            rest = 0  # at most, what a document may still gain
            for n, (v, head) in enumerate(lists):
                stop = int(np.searchsorted(falling[n], -bound, side="right")) if bound > 0 else len(v)  # groups of impact >= bound
                if stop > done[n]:
                    at = slice(head[done[n]], head[stop])
                    total[self.doc[at]] += self.impact[at]  # a document once a term
                    done[n] = stop
                if done[n] < len(v):
                    rest += max(int(v[done[n]]), 0)
            if not rest:
                at = np.flatnonzero(total >= max(1, least))
                return at, total[at]
            reached = least
            if len(total) > k:
                reached = max(reached, int(np.partition(total, len(total) - k)[len(total) - k]))
            if rest < reached:
                break  # no document unseen so far can reach the k-th score
        at = np.flatnonzero(total + rest >= reached)
        at = at[total[at] > 0]
        return at, self.completed(at, query)

    def completed(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        n = self.counts[at]
        rows = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        asked = np.zeros(len(self.first), bool)
        asked[query] = True
        out = np.zeros(len(at), np.int64)
        np.add.at(out, np.repeat(np.arange(len(at)), n), np.where(asked[self.terms[rows]], self.own[rows], 0))
        return out


def scored(rows: DataFrame, queries: list[np.ndarray], weights: np.ndarray, k: int, documents: int, terms: int) -> DataFrame:
    """query, id, score: each task's best k of counted documents for each query."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, weights))
    last = np.iinfo(np.int64).max

    def run(batches):
        queries, weights = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries]

        def take(held):
            ids = np.concatenate([b.column(0).fill_null(last).to_numpy() for b in held])
            none = np.concatenate([b.column(0).is_null().to_numpy(zero_copy_only=False) for b in held])
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            counts = np.concatenate([b.column(2).value_lengths().to_numpy() for b in held]).astype(np.int64)
            held_terms, times = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]).astype(np.int64) for c in (2, 3))
            block = Block(ids, 50 + (50 * n * documents) // terms, counts, held_terms, times, weights)
            for q, query in enumerate(queries):
                had, had_scores, had_none = best[q]
                at, found = block.search(query, k, int(had_scores[-1]) if len(had) == k else 0)
                if len(at):
                    i, s, z = np.concatenate((had, ids[at])), np.concatenate((had_scores, found)), np.concatenate((had_none, none[at]))
                    by = np.lexsort((i, z, -s))[:k]
                    by = by[s[by] > 0]
                    best[q] = i[by], s[by], z[by]

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(2).flatten()) + b.num_rows
            if n >= POSTINGS:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        size = [len(x[0]) for x in best]
        if sum(size):
            ids, scores, none = (np.concatenate([x[c] for x in best]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), size), pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(scores)], ["query", "id", "score"])

    return rows.mapInArrow(run, "query int, id bigint, score bigint")


def best_rows(found: DataFrame, k: int, salts: int) -> DataFrame:
    """query, id, score, rank of the k greatest of each query, first within salted groups."""
    by = [F.desc("score"), F.asc_nulls_last("id")]
    found = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(salts)))
    for part in (["query", "salt"], ["query"]) if salts > 1 else (["query"],):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*by))).where(F.col("rank") <= k)
    return found.select("query", "id", "score", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, rank (from 1), id, score: the k documents of greatest score above 0 for each item, equal scores by ascending id."""
    spark = docs.sparkSession
    arrow_limits(spark)
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kind = asked.schema["item"].dataType.simpleString()
    out = spark.createDataFrame([], f"item {kind}, rank int, id bigint, score bigint")
    for no in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == no).distinct().collect()  # a bounded block
        words = [sorted(set(words_of(r.text.encode()))) for r in rows]
        terms = sorted(set().union(*words)) if words else []
        if not terms:
            continue
        held = materialize(spark, counted(docs, terms, id_col, text_col))
        n, total = held.agg(F.count("*"), F.sum("n")).first()
        if n:
            frequency = np.zeros(len(terms), np.int64)
            for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a query term
                frequency[r.t] = r["count"]
            weights = np.array([weight(n, int(f)) for f in frequency], np.int64)
            place = {t: p for p, t in enumerate(terms)}
            queries = [np.array([place[w] for w in ws], np.int64) for ws in words]
            found = scored(held, queries, weights, k, n, int(total))
            names = spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"query int, item {kind}")
            top = best_rows(found, k, max(1, round((n / DOCUMENTS) ** 0.5)))
            top = materialize(spark, top.join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
            out = top if blocks == 1 else out.union(top)
        forget(spark, held)
    return out
