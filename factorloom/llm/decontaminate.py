"""Benchmark decontamination by an FM-index of each shard of the training texts.

A shard is some megabytes of consecutive documents of one task. Its words become numbers of the benchmark's
vocabulary; all other words are one separator, and runs shorter than the shortest window are left out, as no
window fits in them. The index of what remains is searched backward for every window at once; occurrences are
located by sampled suffix positions and merged into spans of words.

Cases: a null text has no words; an item without words matches nothing; repeated items count once by their id;
an item id of null is written as an empty string; an empty benchmark leaves every document clean; an empty
table gives an empty table. Very long texts are a shard of their own. Extra columns are carried through.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, forget, fresh, materialize
from .fmindex import FMIndex

#: A shard closes at so many bytes of text; the benchmark is sent to tasks in blocks of at most so many bytes.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20
#: Words are runs of digits, letters and bytes from 0x80 on; A-Z are lower-cased; all else separates.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Phrases:
    """The windows of a benchmark, as rows of word numbers by length, and the items of each (names by number).

    Arrays of 32-bit numbers throughout: a block of the benchmark takes some ten times its size while it is numbered, and
    less after."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        named = {item: k for k, item in enumerate(self.names)}
        made: dict[int, list[tuple[int, np.ndarray]]] = {}
        put = self.number.setdefault
        for item, text in items:
            ids = np.array([put(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                made.setdefault(min(len(ids), size), []).append((named[item], ids))
        self.groups = [(n, *self._windows(n, made.pop(n))) for n in sorted(made)]
        self.shortest = self.groups[0][0] if self.groups else 0

    @staticmethod
    def _windows(n: int, texts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of n words, where each one's items begin, and the items."""
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, n) for _, ids in texts])
        item = np.repeat(np.array([k for k, _ in texts], np.int32), [len(ids) - n + 1 for _, ids in texts])
        order = np.lexsort((item, *rows.T[::-1]))
        rows, item = rows[order], item[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))
        fresh_item = new | np.concatenate(([True], item[1:] != item[:-1]))
        window = np.cumsum(new)[fresh_item] - 1
        return rows[new], np.searchsorted(window, np.arange(int(new.sum()) + 1)), item[fresh_item]

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """For the words of a shard's documents: offsets of the documents, a flag for each word, the items of each document."""
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64)))
        hit, found = np.zeros(int(offsets[-1]) + 1, np.int64), [set() for _ in docs]
        if not self.groups or not offsets[-1]:
            return offsets, hit[:-1] > 0, found
        get = self.number.get
        ids = np.zeros(int(offsets[-1]) + len(docs), np.int64)  # a separator after each document
        for k, d in enumerate(docs):
            ids[offsets[k] + k : offsets[k + 1] + k] = np.fromiter(map(get, d, repeat(0)), np.int64, len(d))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        keep = end - start >= self.shortest
        start, end = start[keep], end[keep]
        if not len(start):
            return offsets, hit[:-1] > 0, found
        length = end - start + 1  # with the separator that ends the run
        at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
        seq = ids[at]
        index = FMIndex(seq, len(self.number))
        doc_of = np.searchsorted(offsets[1:] + np.arange(1, len(docs) + 1), at, side="right")
        for n, patterns, first, items in self.groups:
            lo, hi = index.search(patterns)
            count = hi - lo
            if not count.any():
                continue
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            q = index.locate(rows)
            doc = doc_of[q]
            word = at[q] - doc  # without the separators before it
            np.add.at(hit, word, 1)
            np.add.at(hit, word + n, -1)
            for d, w in np.unique(np.stack((doc, which), 1), axis=0).tolist():
                found[d].update(self.names[k] for k in items[first[w] : first[w + 1]].tolist())
        return offsets, np.cumsum(hit)[:-1] > 0, found


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """docs with four new columns, named by the returned dict: n_words, n_hit, items (array of strings, sorted), spans (of words, merged).

    The benchmark goes to the tasks in blocks of bounded size: each block is one pass over the rows, whose spans are merged.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    names = {x: fresh(docs, x) for x in ("n_words", "n_hit", "items", "spans")}
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.encode(F.coalesce(F.col(item_text), F.lit("")), "utf-8").alias("text"))
    total = items.agg(F.sum(F.length("text") + F.length("id") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.select("*", F.lit(0).cast("bigint").alias(names["n_words"]), F.lit(0).cast("bigint").alias(names["n_hit"]), F.array().cast("array<string>").alias(names["items"]), F.array().cast(SPAN).alias(names["spans"]))
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["n_hit"], T.LongType()), T.StructField(names["items"], T.ArrayType(T.StringType())), T.StructField(names["spans"], SPAN)])
    kept = out
    for k in range(blocks):
        if k:  # one block at a time: what the last has found is written, and what it read is deleted
            out = materialize(spark, out)
            forget(spark, kept)
            kept = out
        block = [(r.id, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).distinct().collect()]
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(block), at, width, size), schema)
    return out, names


def _pass(block, at: int, width: int, size: int):
    def run(batches):
        phrases = Phrases(block.value, size)
        waiting, held = [], 0
        for b in batches:
            waiting.append(b)
            held += b.column(at).nbytes
            if held >= SHARD_BYTES:
                yield from shard(phrases, waiting)
                waiting, held = [], 0
        if waiting:
            yield from shard(phrases, waiting)

    def shard(phrases, held):
        docs = [words_of(t) for b in held for t in b.column(at).cast(pa.binary()).to_pylist()]
        offsets, hit, found = phrases.find(docs)
        k = 0
        for b in held:
            n_hit, items, spans = [], [], []
            olds, had = b.column(width + 3).to_pylist(), b.column(width + 2).to_pylist()
            for old, were in zip(olds, had):
                mask = hit[offsets[k] : offsets[k + 1]].copy()
                for s in old:
                    mask[s["start"] : s["end"]] = True
                n_hit.append(int(mask.sum()))
                items.append(sorted(found[k].union(were)))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist() if n_hit[-1] else []
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
                k += 1
            n = [len(d) for d in docs[k - b.num_rows : k]]
            made = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], b.schema.names)

    return run


def is_contaminated(names: dict[str, str]):
    return (F.col(names["n_hit"]) > 0) & (F.col(names["n_hit"]) * 20 >= F.col(names["n_words"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = 13) -> DataFrame:
    """docs without those of which a twentieth of the words or more lies in benchmark windows; all columns stay."""
    out, names = scan(docs, benchmark, text_col, size=size)
    return out.where(~is_contaminated(names)).select(docs.columns)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the given spans (and what stands between them)."""
    if not text or not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]
