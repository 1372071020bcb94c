import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm.periodic import find_runs, runs_in
from factorloom.llm.registered.op13_periodic import query
from factorloom.llm.squares import Names, blocks_of, runs_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(words, least=2, exponent=2):
    """Every stretch whose smallest period is q, that keeps q on neither side: by comparing words q apart."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length, root = end - at + q, words[at : at + q]
            if end > at and length >= max(least, exponent * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((at, length, q))
            at = end + 1 if end == at else end
    return sorted(out, key=lambda r: (r[0], r[2]))


def tuples(found):
    return list(zip(*(x.tolist() for x in found)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 12), st.integers(1, 6))
def test_all_runs_of_a_sequence(s, part, times):
    s = s[:part] * times + s[part:]
    assert tuples(runs_of(np.array([*s, 99]))) == brute(s)


def test_runs_of_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    assert tuples(runs_of(np.array([*b, 7]))) == brute(b)
    assert tuples(runs_of(np.array([*[4] * 500, 7]))) == [(0, 500, 1)]


def test_blocks_begin_earlier_too():
    s = np.array([0, 1, 0, 1, 0, 2, 1, 0, 1, 9])
    assert blocks_of(Names(s)).tolist() == [0, 1, 2, 5, 6, 9]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), max_size=5), st.integers(1, 9))
def test_texts_searched_together(texts, times):
    texts = [t * times if k % 2 else t for k, t in enumerate(texts)]
    for least, exponent in ((6, 4), (2, 2), (5, 3), (2, 3)):
        assert [[tuple(r) for r in x.tolist()] for x in runs_in(texts, least, exponent)] == [brute(t, least, exponent) for t in texts]


def test_cases(spark):
    """Null, empty and blank texts, repeated rows and ids, clashing names, other white space, a long text."""
    long = " ".join(["x", "y", "z"] * 40_000)
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n ", 5), (4, "a b c\ta a a a a a\x0bd", 5), (4, "a b c\ta a a a a a\x0bd", 5), (None, "q " * 5, 5), (6, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _runs int")
    out, c = find_runs(docs)
    assert out.columns[:3] == docs.columns and c["runs"] == "_runs_"
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r[c["runs"]]], r[c["collapsed"]]) for r in out.collect()), key=str)
    line = (4, [(2, 6, 1)], "a b c a d")
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), line, line, (0, [], "q q q q q"), (6, [(0, 120_000, 3)], "x y z")], key=str)
    assert find_runs(docs.where("doc_id > 99"))[0].count() == 0


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 6, 4)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 5000").collect()
    got = {r.doc_id: tuple(r) for r in query(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d in docs:
        assert got[d.doc_id] == expected(d.doc_id, d.text)
