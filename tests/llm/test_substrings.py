import random

import numpy as np
import pytest

from factorloom.llm import substrings as s
from factorloom.llm.decontaminate import words_of


def sentence(n, rng):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def edited(text, n, rng):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "new%d" % rng.randint(0, 10**9)
    return " ".join(w)


def shingles(words):
    return {tuple(words[k : k + s.SHINGLE]) for k in range(max(1, len(words) - s.SHINGLE + 1))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def lines_of(text):
    """The lines and whole short texts that are compared, as (first word, words)."""
    out, at, total = [], 0, words_of(text.encode())
    for line in text.replace("\r", "\n").split("\n"):
        w = words_of(line.encode())
        if len(w) >= s.SIZE:
            out.append((at, w))
        at += len(w)
    return out + ([(0, total)] if 0 < len(total) < s.SIZE else [])


def corpus():
    rng = random.Random(3)
    shared, other = sentence(51, rng), sentence(120, rng)
    docs = {k: sentence(rng.randint(0, 300), rng) for k in range(40)}
    for k in (1, 5, 9):
        docs[k] = sentence(33, rng) + " " + (shared.upper() if k == 5 else shared.replace(" ", ", ")) + " " + sentence(41, rng)
    docs[20] = docs[21] = other
    near = other.split()
    near[60] = "changed"
    docs[22] = " ".join(near)
    docs[23], docs[24], docs[25] = None, "", sentence(25, rng)
    docs[26] = docs[25]
    return docs


def test_finds_planted_repeats_and_leaves_the_rest(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] + [(None, docs[20], 2), (21, docs[21], 3), (7, docs[20], 4)], "doc_id long, text string, own int")
    rows = s.repeats(df).collect()
    assert {r.id for r in rows} == {1, 5, 9, 7, 20, 21, 22, 25, 26}
    # At the passage's edges a paragraph may be chosen in two of the three only.
    assert {(r.root_id, r.id) for r in rows if r.id in (1, 5, 9)} >= {(1, 1), (1, 5), (1, 9)}
    assert all(r.removed == (r.id != r.root_id) for r in rows)
    out = s.remove_repeats(df)
    assert out.columns == df.columns
    left = {(r.doc_id, r.own): r.text for r in out.collect()}
    gone = [(20, 1), (21, 1), (21, 3), (22, 1), (26, 1)]
    assert not any(k in left for k in gone) and left[7, 4] == docs[20] and left[7, 1] == docs[7] and left[None, 2] == docs[20]
    for k, t in docs.items():
        if k not in (5, 9, 20, 21, 22, 26):
            assert left[k, 1] == t
    for k in (5, 9):
        kept, whole = words_of(left[k, 1].encode()), words_of(docs[k].encode())
        assert kept == whole[:33] + whole[84:]
    kept = {(r.doc_id, r.own): r.text for r in s.remove_repeats(df, drop_empty=False).collect()}
    assert kept[21, 1] == "" and len(kept) == df.count()


def test_empty_table_and_clashing_names(spark):
    rng = random.Random(1)
    text = sentence(60, rng)
    df = spark.createDataFrame([(1, text, 1, 1, "x"), (2, text, 2, 2, "y")], "doc_id long, text string, id int, key int, _runs string")
    assert s.repeats(df.limit(0)).count() == 0 and s.remove_repeats(df.limit(0)).count() == 0
    out = s.remove_repeats(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, text, 1, 1, "x")]
    strings = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert {(r.id, r.root_id) for r in s.repeats(strings).collect()} == {("a", "a"), ("b", "a")}


def test_recall_of_all_pairs_at_the_registered_parameters(spark):
    """All lines compared with all, words against words: what the bands find of them."""
    rng = random.Random(11)
    docs = {}
    for k in range(0, 400, 2):
        line = sentence(rng.randint(26, 120), rng)
        docs[k] = sentence(30, rng) + "\n" + line + "\n" + sentence(30, rng)
        docs[k + 1] = sentence(30, rng) + "\n" + edited(line, rng.randint(0, 3), rng) + "\n" + sentence(30, rng)
    every = [(k, p, w) for k, t in docs.items() for p, w in lines_of(t)]
    want = {((i, p), (j, q)) for x, (i, p, v) in enumerate(every) for j, q, w in every[x + 1 :] if i != j and jaccard(v, w) >= s.LIKENESS}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    size = {(k, p): len(w) for k, p, w in every}
    root = {(r.id, r.pos): (r.root_id, r.root_pos) for r in s.repeats(df).collect() if r.size == size.get((r.id, r.pos))}
    found = {(x, y) for x, y in want if x in root and root[x] == root.get(y)}
    assert len(want) > 100 and len(found) >= 0.97 * len(want)
    assert all((r, a) in want or a == r for a, r in root.items())  # and nothing else


def chained(seed):
    """Three paragraphs, the first like the second, the second like the third, the first not like the third."""
    rng = random.Random(seed)
    a = sentence(s.SIZE, rng).split()
    b = ["p", *a[1:]]
    b[1] = "q"
    c = [*b[:-2], "x", "y"]
    return [" ".join(w) for w in (a, b, c)]


def numbered(texts):
    number = {}
    return [np.unique([number.setdefault(x, len(number)) for x in shingles(t.split())]) for t in texts]


def test_all_of_a_bucket_are_compared(spark):
    texts = [t for k in range(200) for t in chained(k)]
    j = lambda x, y: jaccard(texts[x].split(), texts[y].split())
    assert j(0, 1) >= 0.8 <= j(1, 2) and j(0, 2) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.id: r.root_id for r in s.repeats(df).collect()}
    pairs = [(3 * k + x, 3 * k + x + 1) for k in range(200) for x in (0, 1)]
    assert sum(a in root and root[a] == root.get(b) for a, b in pairs) >= 0.98 * len(pairs)
    # One bucket that holds the chain and others that share a phrase with it: no link is lost, whatever their order.
    rng = random.Random(1)
    for _ in range(6):
        words = chained(3) + [" ".join(chained(3)[0].split()[:15]) + " " + sentence(11, rng) for _ in range(30)]
        rng.shuffle(words)
        a, b, c = (words.index(t) for t in chained(3))
        assert {frozenset(x) for x in s.alike(numbered(words), 0.8, lambda i, j: False)} >= {frozenset((a, b)), frozenset((b, c))}


def test_links_of_a_bucket_join_what_all_pairs_join():
    rng = random.Random(4)
    base = sentence(40, rng)
    texts = list({edited(base, rng.randint(0, 2), rng) for _ in range(80)})
    up = list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(texts)):
        for k in range(i):
            if jaccard(texts[i].split(), texts[k].split()) >= 0.8:
                up[find(i)] = find(k)
    own = list(range(len(texts)))
    at = lambda x: x if own[x] == x else at(own[x])
    for i, k in s.alike(numbered(texts), 0.8, lambda i, j: False):
        assert jaccard(texts[i].split(), texts[k].split()) >= 0.8
        own[at(i)] = at(k)
    same = lambda f: {frozenset(x for x in range(len(texts)) if f(x) == f(k)) for k in range(len(texts))}
    assert same(find) == same(at)


def test_the_number_of_rows_decides_nothing(spark, monkeypatch):
    rng = random.Random(6)
    phrase = sentence(18, rng)
    texts = [phrase + " " + sentence(12, rng) for _ in range(120)]
    texts += [t.rsplit(" ", 2)[0] + " m n" for t in texts[1:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for rest in (10, 10**6):
        monkeypatch.setattr(s, "REST", rest)
        got.append({(r.id, r.pos, r.root_id) for r in s.repeats(df, recall=0.5).collect()})
    assert got[0] == got[1] and got[0]


def test_bands():
    assert s.bands_for(0.8, 0.98) == 4 and s.bands_for() == 5


def test_word_hashes_follow_the_words(monkeypatch):
    texts = [b"One two, one", None, b"", b"two " * 5, "é x y é".encode(), b"-"]
    h, n = s.word_hashes(texts)
    words = [w for t in texts for w in words_of(t)]
    assert n.tolist() == [len(words_of(t)) for t in texts] and len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) and len(set(zip(h.tolist(), words))) == len(set(words))
    assert s.word_hashes([])[0].size == 0
    monkeypatch.setattr(s, "PIECE", 4)  # in pieces
    assert s.word_hashes(texts)[0].tolist() == h.tolist()


def test_contents_follow_the_words():
    rng = random.Random(2)
    shared = sentence(60, rng)
    texts = [(sentence(rng.randint(0, 40), rng) + " " + shared + "\n" + shared.upper() + "\n" + sentence(rng.randint(0, 40), rng)).encode() for _ in range(20)] + [b"", None, b"a b", b"A, b"]
    p = s.Paragraphs(texts)
    words = [words_of(t) for t in texts]
    own = [tuple(words[d][a : a + n]) for d, a, n in zip(p.doc, p.start, p.size)]
    for h in (p.a, p.b):
        assert len(set(zip(h.tolist(), own))) == len(set(own)) == len(set(h.tolist()))
    assert all(len(w) >= s.SIZE or len(w) == 2 for w in own)
    each = s.Paragraphs([texts[3]])
    assert sorted(zip(each.start, each.size, each.a)) == sorted((a, n, x) for d, a, n, x in zip(p.doc, p.start, p.size, p.a) if d == 3)


def test_lines_and_short_texts_are_paragraphs(spark):
    rng = random.Random(8)
    short, long, text = sentence(3, rng), sentence(60, rng).split(), sentence(12, rng)
    near = [*long[:30], "changed", *long[31:]]
    # A whole text of few words that is broken otherwise, a line of 60 with one word changed; a heading of three words is left alone.
    docs = {k: sentence(40, rng) + "\n" + x + "\n" + sentence(40, rng) for k, x in enumerate((short, short.upper(), " ".join(long), " ".join(near), sentence(9, rng)))}
    docs |= {10: text, 11: text.replace(" ", "\n", 1), 12: edited(text, 1, rng)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.id, r.pos, r.size, r.root_id) for r in s.repeats(df, recall=0.999).collect()}
    assert got == {(2, 40, 60, 2), (3, 40, 60, 2), (10, 0, 12, 10), (11, 0, 12, 10)}
    left = {r.doc_id: words_of(r.text.encode()) for r in s.remove_repeats(df).collect()}
    assert len(left[1]) == 83 and len(left[3]) == 80 and 11 not in left and left[2] == words_of(docs[2].encode())


def test_the_whole_passage_goes(spark):
    rng = random.Random(9)
    docs = {}
    for k in range(0, 60, 2):
        passage = sentence(51 + k, rng)
        for j in (k, k + 1):
            docs[j] = sentence(30, rng) + " first%d " % j + passage + " last%d " % j + sentence(30, rng)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    left = {r.doc_id: words_of(r.text.encode()) for r in s.remove_repeats(df).collect()}
    for k in range(0, 60, 2):
        whole = words_of(docs[k + 1].encode())
        assert left[k] == words_of(docs[k].encode()) and left[k + 1] == whole[:31] + whole[-31:]


def test_a_very_long_text_and_a_hot_passage(spark):
    rng = random.Random(10)
    passage = sentence(55, rng)
    docs = {k: sentence(20, rng) + " " + passage + " " + sentence(20, rng) for k in range(1, 300)}
    docs[0] = "\n".join(sentence(2000, rng) + " " + passage for _ in range(30)) + "x" * 300_000
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    found = s.repeats(df).collect()
    assert {r.id for r in found} == set(docs) and {r.root_id for r in found} == {0}
    left = {r.doc_id: words_of(r.text.encode()) for r in s.remove_repeats(df).collect()}
    assert left[0] == words_of(docs[0].encode()) and all(len(left[k]) == 40 for k in range(1, 300))


@pytest.mark.parametrize("text", ["a, b. c", "É é  ü\n\nz", "x"])
def test_cutting_keeps_what_stands_around(text):
    words = words_of(text.encode())
    assert s.cut(text, [{"start": 0, "stop": len(words), "side": 0, "words": []}]) is None
    if len(words) > 1:
        left = s.cut(text, [{"start": 1, "stop": len(words), "side": 1, "words": []}])
        assert words_of(left.encode()) == words[:1] and text.startswith(left[:1])
