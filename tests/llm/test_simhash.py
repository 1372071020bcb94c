import random

import pytest
import xxhash

from factorloom.llm.simhash import blocks, classes, drop_near_duplicates, fingerprint, linked

random.seed(5)


def brute_print(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, threshold=2):
    ids = list(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= threshold:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def texts():
    words = ["alpha", "beta", "Gamma", "delta", "Été", "x", "12", "zeta"]
    out = [" ".join(random.choices(words, k=random.randint(0, 40))) for _ in range(30)]
    base = " ".join(random.choices(words, k=300))
    out += [base, base, base + " more", "new " + base, None, "", "   \t\n", "one", "one two", "a b c", base * 40]
    return out


def test_fingerprint_is_the_defined_one():
    for t in texts():
        assert fingerprint((t or "").encode()) == brute_print(t)


def test_classes_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in classes(df).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert got == {i: (prints[i], c) for i, c in roots(prints).items()}


@pytest.mark.parametrize("blocks_for", [4, 5000, 10**7])
def test_links_lose_no_pair(spark, blocks_for):
    prints = set()
    for _ in range(20):
        x = random.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            x ^= 1 << random.randrange(64)
    prints = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {(r.a, r.b) for r in linked(spark, spark.createDataFrame([(p,) for p in prints], "fp long"), code=blocks(blocks_for)).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_filter_keeps_one_row_of_each_component(spark):
    df = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "s"), (2, "A b c d", "t"), (3, None, "u"), (4, "", "v"), (5, "quite other words here", None)], "doc_id long, text string, keep string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_filter_keeps_null_ids_of_different_components(spark):
    rows = [(None, "one text that stands alone here", "a"), (None, "quite another story with other words", "b"), (None, "quite another story with other words", "b"), (1, "the third of them all", "c"), (None, "the third of them all", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    assert sorted(r.keep for r in drop_near_duplicates(df).collect()) == ["a", "b", "c"]


def test_joins_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    """Whatever Spark takes their sizes for: the driver would gather them."""
    from factorloom.llm import simhash

    docs = spark.createDataFrame([(k, f"word{k % 40} and some more words of text {k % 40}") for k in range(200)], "doc_id long, text string")
    plans, join = [], type(docs).join

    def kept(self, other, *a, **k):
        out = join(self, other, *a, **k)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(docs), "join", kept)
    assert simhash.drop_near_duplicates(docs).count() == 40
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]
