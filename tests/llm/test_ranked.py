import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import ranked as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    out = {}
    for item, text in items:
        terms, rows = set(words(text)), []
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in terms}
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(weights[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((-score, i is None, i))
        out[item] = [(r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return {i: r for i, r in out.items() if r}


def ranks(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (str(r.item), r.rank)):
        out.setdefault(r.item, []).append((r.rank, r.id, r.score))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "naïve", "ÄB"]
    share = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(k, " ".join(rng.choices(vocabulary, share, k=rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("postings", [50, 400_000])
def test_ranks_equal_brute_force(spark, monkeypatch, postings):
    """With copies (ties), a frequent word, several blocks of documents and of queries."""
    monkeypatch.setattr(R, "POSTINGS", postings)
    docs = corpus(400, 1) + [(1000 + k, "w5 w7 w9 w11 shared, words!") for k in range(60)]
    items = [(k, t) for k, (_, t) in enumerate(corpus(25, 2))] + [(90, "shared w7"), (91, "absent"), (92, "w0 W0 w0")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 10)
    assert ranks(R.search(d, q, 10)) == want
    assert ranks(R.search(d, q, 10, block_bytes=800)) == want


def test_descent_stops_early_and_is_exact():
    """A block whose k-th score is proved before the frequent term's postings are all read."""
    rng = np.random.default_rng(4)
    n = 5000
    rare = rng.choice(n, 40, replace=False)
    counts = np.ones(n, np.int64)
    counts[rare] = 2
    terms = np.concatenate([[0, 1] if k in set(rare.tolist()) else [0] for k in range(n)])
    times = rng.integers(1, 4, len(terms))
    block = R.Block(np.arange(n), np.full(n, 100), counts, terms, times, np.array([3, 4000]))
    read = []
    whole = block.completed
    block.completed = lambda at, query: read.append(len(at)) or whole(at, query)
    at, score = block.search(np.array([0, 1]), 20, 0)
    assert read and read[0] <= 40
    every = whole(np.arange(n), np.array([0, 1]))
    assert sorted(score.tolist(), reverse=True)[:20] == sorted(every.tolist(), reverse=True)[:20]
    at, score = block.search(np.array([0, 1]), 20, int(every.max()))
    assert (score >= every.max()).sum() == (every == every.max()).sum()


def test_cases(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names, no documents, no items."""
    long = "alpha " * 50_000 + "beta"
    docs = [(1, "alpha beta", 1), (1, "alpha beta", 1), (2, None, 2), (3, "", 3), (None, "Alpha beta", 4), (4, long, 5), (5, "..., -", 6), (6, "gamma", 7)]
    items = [(1, "alpha?", 1), (1, "alpha?", 1), (2, None, 1), (3, "--", 1), (None, "beta alpha", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, rank int")
    q = spark.createDataFrame(items, "item_id long, text string, score int")
    want = brute([r[:2] for r in docs], [(1, "alpha?"), (None, "beta alpha")], 3)
    assert ranks(R.search(d, q, 3)) == want
    assert R.search(d.where("doc_id > 99"), q).count() == 0
    assert R.search(d, q.where("item_id > 99")).count() == 0
