import hashlib
import random
import re

from factorloom.llm.decontaminate import BLOCK_BYTES, Phrases, cut_spans, is_contaminated, scan, words_of
from factorloom.llm.fmindex import FMIndex

import numpy as np


def brute(docs, bench, size=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for t in docs:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            for win in [b[k : k + size] for k in range(max(1, len(b) - size + 1))] if b else []:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        items.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(items)))
    return out


def test_words():
    assert words_of("It's Ünï-42\x7fx_y É".encode()) == [w.encode() for w in ("it", "s", "Ünï", "42", "x", "y", "É")]
    assert words_of(None) == words_of(b" .,") == []


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 4, 500)
    seq[-1] = 0
    index = FMIndex(seq, 3)
    for n in (1, 2, 3):
        patterns = rng.integers(1, 4, (20, n))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [k for k in range(500 - n + 1) if (seq[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_scan_matches_brute_force_in_one_block_and_in_many(spark):
    random.seed(3)
    vocab = [f"w{k}" for k in range(6)] + ["É", "7"]
    bench = [(k, " ".join(random.choices(vocab, k=n))) for k, n in enumerate([30, 14, 13, 5, 2, 0, 25])] + [(None, "w1 w1 w1 É"), (2, "w0 w0 w0 w0 w0"), (3, None)]
    docs = []
    for _ in range(60):
        t = random.choices(vocab + ["other", "more"], k=random.randint(0, 40))
        t[3:3] = (random.choice(bench)[1] or "").split()
        docs.append(", ".join(t).upper() if random.random() < 0.3 else " ".join(t))
    docs += [None, "", "...", " ".join(docs * 20)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id long, text string, _n_hit int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for block in (1 << 20, 300):
        out, c = scan(df, b, block_bytes=block)
        rows = sorted(out.collect(), key=lambda r: r.doc_id)
        assert [(r[c["n_words"]], r[c["n_hit"]], r[c["items"]]) for r in rows] == want
        assert all(sum(s.end - s.start for s in r[c["spans"]]) == r[c["n_hit"]] for r in rows)


def test_empty_tables_and_cutting(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    out, c = scan(df, none)
    assert out.where(is_contaminated(c)).count() == 0 and out.count() == 1
    out, c = scan(df.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert out.count() == 0
    assert cut_spans("One, TWO three! four", [(1, 3)]) == "One, ! four"
    assert cut_spans(None, [(0, 1)]) is None
    assert Phrases([], 13).find([[b"a"]])[1].tolist() == [False]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_a_block_of_the_benchmark_is_small():
    """A megabyte: a block of eight takes eight times that, under 300 MB."""
    import tracemalloc

    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(60_000)]
    items, n = [], 0
    while n < 1 << 20:
        items.append((str(len(items)), " ".join(rng.choices(vocab, k=rng.randint(1, 300))).encode()))
        n += len(items[-1][1])
    tracemalloc.start()
    phrases = Phrases(items, 13)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert BLOCK_BYTES <= 8 << 20 and most < 36 << 20 and held < 20 << 20 and len(phrases.groups) == 13


def test_repeated_rows_and_tables_of_blocks(spark):
    import os

    words = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, words), (1, words), (None, words), (2, "x y")], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(f"w{n}" for n in range(k, k + 13))) for k in range(6)], "item_id long, text string")
    scan(df, b, block_bytes=200)[0].count()
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    out, c = scan(df, b, block_bytes=200)
    rows = out.collect()
    assert [(r[c["n_hit"]], len(r[c["items"]])) for r in sorted(rows, key=lambda r: str(r.doc_id))] == [(18, 6), (18, 6), (0, 0), (18, 6)]
    assert len(set(os.listdir(base)) - before) == 1  # what the last block reads
