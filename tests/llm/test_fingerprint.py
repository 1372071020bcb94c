import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from factorloom.llm import fingerprint as fp


def canon(t):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"[\s\x85]+", " ", n(n(t or "").casefold())).strip(" ")


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, canon int")
    got = sorted(fp.fingerprints(df, **more).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(order)
    named = {}
    by_id = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        by_id.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)), canon(t), canon(edited)))
    for i, want in by_id.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.n_chars, r.edited_sha256))
        for r, (n, sha, ne, nn, c, e) in zip(mine, sorted(want)):
            assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, ne, nn)
            assert named.setdefault(r.fingerprint, c) == c and named.setdefault(r.edited_fingerprint, e) == e
    assert len(set(named.values())) == len(named)


ROWS = [(5, "Ｆｕｌｌ  Width"), (3, "full width"), (9, None), (8, ""), (7, "x"), (-2, "Straße 😀😀"), (-3, "STRASSE 😀😀"), (11, "é a"), (12, "É A"), (20, "long " * 3000), (21, " \n\t ")]


def test_contract(spark):
    check(spark, ROWS)


def test_repeated_rows_and_null_ids(spark):
    check(spark, [(1, "one two"), (1, "one two"), (1, "other"), (None, "nothing"), (4, "4")])
    check(spark, [(1, "only one row")])
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_parts(spark, monkeypatch):
    random.seed(1)
    ids = random.sample(range(10**6), 4000)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").select("*", F.lit(1).alias("h1"), F.lit(2).alias("h2"))
    ids.sort(reverse=True)
    for rows, ranges in ((1000, 1024), (500, 7), (100, 7)):  # four ranges, seven, seven times six
        monkeypatch.setattr(fp, "RANGE_ROWS", rows)
        monkeypatch.setattr(fp, "RANGES", ranges)
        made = fp.with_next(df)
        got = {r.id: r.next_text for r in made.collect()}
        assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_ranges_of_ranges_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    monkeypatch.setattr(fp, "RANGES", 3)
    check(spark, [(k // 2 if k % 3 else None, f"text {k}") for k in range(24)] + ROWS)


def test_equal_hashes_of_different_bytes_are_told_apart(spark):
    check(spark, ROWS + [(30, "abc"), (31, "abd")], hashes=lambda c: [F.pmod(F.xxhash64(c), F.lit(2)), F.lit(0).cast("bigint")])


def test_an_edited_text_that_meets_another_hash_is_told_apart(spark):
    # The edited "ab" is "ac"; its hash is made that of "cd".
    check(spark, [(2, "ab"), (1, "cd")], hashes=lambda c: [F.when(c.isin("ac", "cd"), 1).otherwise(F.xxhash64(c)), F.lit(0).cast("bigint")])


def test_columns_of_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a" * 200_000, 1, "x"), (2, "b", 2, "y")], "doc_id long, text string, h1 int, bucket string")
    got = {r.doc_id: (r.n_chars, r.near_edited) for r in fp.fingerprints(df).collect()}
    assert got == {1: (200_000, 0.0), 2: (1, 1.0)}
