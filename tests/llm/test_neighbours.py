import os

import numpy as np
import pytest

from factorloom.llm import neighbours as N
from factorloom.llm.registered.op12_neighbours import query

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, asked):
    """Of (id, vector) rows, for each asked id: (rank, id, score) by score and id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in asked:
        score = (x * x[np.flatnonzero(ids == q)[0]]).sum(1)
        by = [m for m in np.lexsort((ids, -score)) if ids[m] != q][:k]
        out[q] = [(n + 1, int(ids[m]), score[m]) for n, m in enumerate(by)]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for _, i, _ in got.get(q, [])} & {i for _, i, _ in rows}) / len(rows) for q, rows in want.items()])


def test_pairs_come_by_falling_sum():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7).round(1), rng.normal(size=5).round(1)
    pairs = list(N.in_order(a, b))
    assert sorted(pairs) == [(i, j) for i in range(7) for j in range(5)]
    sums = [a[i] + b[j] for i, j in pairs]
    assert all(x >= y - 1e-12 for x, y in zip(sums, sums[1:]))


def test_visits_end_with_enough_entries():
    assert N.visited(np.array([3.0, 1.0]), np.array([0.5, 0.0]), [2, 0, 5, 1], 3) == [0, 2]
    assert N.visited(np.array([3.0, 1.0]), np.array([0.5, 0.0]), [2, 0, 5, 1], float("inf")) == [0, 2, 3]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))) * rng.uniform(0.5, 2, (1500, 1))
    x[300:900] = x[300]  # one vector of many ids
    return [(n, [float(np.float32(v)) for v in r]) for n, r in enumerate(x)]


def test_all_cells_are_exact_and_fewer_reach_the_recall(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "SHARD", (64, 64))  # several shards, cells dealt over more than one
    monkeypatch.setattr(N, "QUERIES", 20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, 10, range(0, 1500, 20))
    got = by_query(N.search(df, df.where(N.every(20)), 10, None))
    assert {q: [r[:2] for r in x] for q, x in got.items()} == {q: [r[:2] for r in x] for q, x in want.items()}
    assert max(abs(a[2] - b[2]) for q in want for a, b in zip(got[q], want[q])) < 1e-12
    got = by_query(N.search(df, df.where(N.every(20)), 10, 0.95))
    assert recall(got, want) >= 0.9 and all([r[0] for r in x] == list(range(1, 11)) for x in got.values())


def test_fewer_entries_are_needed_where_vectors_cluster(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] * 4 + rng.normal(size=(2000, 16)) * 0.3
    halves = N.Halves(x, 20)
    cell = halves.cells(x)
    sizes = np.bincount(cell, minlength=400)
    df = spark.createDataFrame([([float(v) for v in r], int(c), n, 0) for n, (r, c) in enumerate(zip(x, cell))], "vec array<double>, cell int, h1 long, h2 long")
    needed = N.entries_needed(df, df.limit(50).collect(), halves, sizes.tolist(), 10, 0.95)
    assert needed < 500


def test_cases(spark):
    """Nulls, zeros, other numbers, other lengths, null and repeated ids, negative zero, clashing names, few candidates."""
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0, 2.0], 1), (0, [1.0, 0.0, 2.0], 2), (1, [1.0, -0.0, 2.0], 1), (2, [0.0, 1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 1.0], 1), (6, [nan, 1.0, 1.0], 1), (7, [inf, 1.0, 1.0], 1), (8, [1.0], 1), (None, [9.0, 9.0, 9.0], 1), (9, [], 1), (20, [-1.0, 3.0, 0.5], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, h1 int")
    got = by_query(N.search(df, df.where(N.every(20)), 3, None))
    assert got == {0: [(1, 1, 5.0), (2, 2, 0.0), (3, 20, 0.0)], 20: [(1, 2, 3.0), (2, 0, 0.0), (3, 1, 0.0)]}
    assert N.search(df.where("vec_id > 99"), df, 3).count() == 0
    assert N.search(df, df.where("vec_id > 99"), 3).count() == 0
    one = df.where("vec_id = 2")
    assert N.search(one, one, 3).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_reaches_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = query(spark, SF)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = by_query(found), brute(rows, 20, [r[0] for r in rows if r[0] % 20 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    scores = {(q, i): s for q, x in want.items() for _, i, s in x}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, x in got.items() for _, i, s in x if (q, i) in scores)
