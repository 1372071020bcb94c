import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import masks as M
from factorloom.operators.kmeans import MaskedKMeans, assign, one_hot
from factorloom.operators.models import Cells, Factorizer, Priors, spark_sides
from factorloom.operators.trials import GreedySearch, GridSearch, LineSearch, Search, Setup, find_best, fold_numbers, greedy_search_cv, line_search_cv, matrix_cv, nested_cv
from factorloom.sources import matrices
from factorloom.sources.synthetic import generate_nmf, generate_nmtf, local_toy, noise_precision


@pytest.fixture(scope="module")
def toy():
    return local_toy(30, 20, 3, fraction=0.2, seed=4)


def frame(spark, cells):
    return spark.createDataFrame([(int(i), int(j), float(r)) for i, j, r in zip(cells.i, cells.j, cells.r)], "i long, j long, r double")


@pytest.mark.parametrize("method", ["np", "icm", "vb"])
@pytest.mark.parametrize("l", [None, 2])
def test_executors_and_process_give_equal_fits(spark, toy, method, l):
    train, _ = toy
    model = lambda: Factorizer(method, 2, l, Priors(rows=1.0, columns=1.0), "random", seed=3)
    sides = spark_sides(frame(spark, train), 30, 20)
    far = model().fit(*sides, 2)
    near = model().fit(*train.sides(), 2)
    assert far.history[-1]["MSE"] == pytest.approx(near.history[-1]["MSE"], rel=1e-9)
    assert np.allclose(far.u, near.u) and np.allclose(far.v, near.v)
    for s in sides:
        s.close()


def test_uncovered_matrix_is_refused(spark, toy):
    with pytest.raises(ValueError, match="unobserved row"):
        spark_sides(frame(spark, toy[0]), 31, 20)


def test_masks(spark, toy):
    obs = frame(spark, toy[0])
    n = len(toy[0].r)
    assert M.random_mask(spark, 30, 20, 0.25, 1).count() == 450
    parts = {r.split: r["count"] for r in M.split(obs, 30, 20, 0.3, 1).groupBy("split").count().collect()}
    assert parts["train"] == int(600 * 0.7) and sum(parts.values()) == n
    folded = M.folds(obs, 7, 1)
    sizes = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert [sizes[f] for f in range(7)] == [int((f + 1) * n / 7) - int(f * n / 7) for f in range(7)]
    assert M.try_folds(obs, 3, 20, 1).count() == n and M.covers(obs, 30, 20)
    assert M.complement(obs, 30, 20).count() == 600 - n
    some = M.folds_of(obs, "i", 5, 3, 1)
    assert some.where("i >= 5 and fold <> -1").count() == 0 and some.where("i < 5 and fold = -1").count() == 0
    assert M.training(folded, 2).where("fold = 2").count() == 0
    ranks = [r.p for r in M.ranked(obs, M.shuffle_key(1, "i", "j"), ["i", "j"]).collect()]
    assert sorted(ranks) == list(range(n))
    with pytest.raises(ValueError, match="missing already"):
        M.try_split(obs, 30, 20, 0.1, 2, 1)
    with pytest.raises(ValueError, match="attempts"):
        M.attempt(lambda s: s, lambda m: False, 3, 0)
    assert M.lost_lines(spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 1)], "i long, j long, fold int"), "i").collect()[0].i == 0


def test_kmeans():
    rng = np.random.default_rng(1)
    centres = np.array([[0.0, 0, 0], [10, 10, 10], [0, 10, 0]])
    x = np.concatenate([c + rng.normal(0, 0.3, (20, 3)) for c in centres])
    m = rng.random(x.shape) < 0.8
    m[~m.any(1), 0] = True
    i, j = np.nonzero(m)
    found = MaskedKMeans(3, 3).fit(i, j, x[i, j], 60, 4)  # the fourth coordinate is never observed
    assert len({tuple(found[k * 20 : k * 20 + 20]) for k in range(3)}) == 3
    assert one_hot(found, 3).sum() == 60
    near, d = assign(np.array([[1.0, 0], [0, 0]]), np.array([[1.0, 0], [0, 1.0]]), np.array([[1.0, 5], [1, 9]]), np.array([[1.0, 0], [1, 0]]))
    assert near.tolist() == [0, 1] and math.isnan(d[1])  # ties to the first, nothing in common to the last
    with pytest.raises(ValueError, match="greater than 0"):
        MaskedKMeans(0)
    with pytest.raises(ValueError, match="unobserved row"):
        MaskedKMeans(1).fit(np.array([0]), np.array([0]), np.array([1.0]), 2, 1)
    with pytest.warns(UserWarning):
        MaskedKMeans(4, 1).fit(np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([1.0, 1.0, 1.0]), 3, 1)


def test_kmeans_begins_the_tri_model(toy):
    for method in ("np", "icm", "gibbs", "vb"):
        fit = Factorizer(method, 3, 2, Priors(), "kmeans", seed=2).fit(*toy[0].sides(), 3, toy[0])
        assert np.isfinite(fit.history[-1]["MSE"])


def canned(values):
    s = Search(Setup("icm"))
    s.results = {k: {"BIC": v, "loglikelihood": v} for k, v in values.items()}
    return s


def test_best_values():
    line = canned({(1, None): 5.0, (2, None): 3.0, (4, None): 3.0, (5, None): math.nan})
    assert line.best_value("BIC") == 2 and line.best("loglikelihood") == 1
    assert canned({(1, 3): 2.0, (2, 4): 1.0}).best_value("BIC") == (2, 4)
    with pytest.raises(ValueError, match="Unrecognised metric"):
        line.all_values("FAIL")
    assert find_best({'{"K": 1}': {"MSE": math.nan}, '{"K": 2}': {"error": "x"}, '{"K": 3}': {"MSE": 4.0}}) == {"K": 3}


def test_searches(spark, toy):
    train, _ = toy
    setup = Setup("vb", Priors(rows=1.0, columns=1.0, middle=1.0), "random", iterations=60, restarts=2, seed=1)
    line = LineSearch(setup, [1, 3, 6]).search(spark, train)
    assert len(line.results) == 3 and line.best_value("AIC") == 3 and line.frame(spark).count() == 15
    small = Setup("icm", iterations=5, init="random", seed=1)
    assert len(GridSearch(small, [1, 2], [1, 2]).search(spark, train).results) == 4
    greedy = GreedySearch(small, [1, 2, 3], [3, 2, 1])
    greedy.search(spark, train, "MSE")
    assert len(greedy.results) <= 9 and greedy.best_value("MSE") in greedy.results


def test_cross_validation(spark, toy):
    train, _ = toy
    fold = fold_numbers(train, 4, 1)
    n = len(fold)
    assert [int((fold == f).sum()) for f in range(4)] == [int((f + 1) * n / 4) - int(f * n / 4) for f in range(4)]
    setup = Setup("icm", Priors(rows=1.0, columns=1.0), "random", iterations=30, seed=1)
    out = line_search_cv(spark, train, setup, [1, 3], 3)
    assert len(out.performances) == 3 and out.average["MSE"] == pytest.approx(np.mean([p["MSE"] for p in out.performances]))
    assert out.frame(spark).count() == 9
    assert len(greedy_search_cv(spark, train, setup, [1, 2], [1, 2], 2).performances) == 2
    found = matrix_cv(spark, train, setup, [{"K": 1}, {"K": 3}, {"K": 2, "L": 2}], 3)
    assert find_best(found)["K"] in (1, 2, 3) and all(len(v["folds"]) == 3 for v in found.values())
    failed = matrix_cv(spark, train, Setup("icm", init="bad"), [{"K": 1}], 2)
    assert "error" in next(iter(failed.values()))
    assert len(nested_cv(spark, train, setup, [{"K": 1}, {"K": 3}], 2).performances) == 2


def test_generators(spark):
    u, v, r = generate_nmf(spark, 40, 30, 3, tau=math.inf, seed=2)
    again = generate_nmf(spark, 40, 30, 3, tau=math.inf, seed=2)[2].repartition(7)
    key = lambda d: sorted((x.i, x.j, x.r) for x in d.collect())
    assert key(r) == key(again)
    m = u.select(F.explode("vec").alias("x")).agg(F.avg("x")).first()[0]
    assert 0.7 < m < 1.3
    f, s, g, r = generate_nmtf(spark, 40, 30, 3, 2, tau=4.0, seed=2)
    e = r.agg(F.var_pop(F.col("r") - F.col("true_r"))).first()[0]
    assert s.shape == (3, 2) and 0.2 < e < 0.3
    assert noise_precision(r, 0) == math.inf and noise_precision(r, 0.5) > 0


def test_sources(spark, tmp_path):
    text = "cell_line,cancer_type,tissue,d1,d2\nA,x,t,1.5,\nB,y,t,,-2\nC,y,u,3,4\n"
    (tmp_path / "s.csv").write_text(text)
    obs, rows, columns = matrices.read_sensitivity(spark, str(tmp_path / "s.csv"))
    got = sorted((r.i, r.j, r.r) for r in obs.collect())
    assert got == [(0, 0, 1.5), (1, 1, -2.0), (2, 0, 3.0), (2, 1, 4.0)] and columns.count() == 2
    shifted = {(r.i, r.j): r.shifted for r in matrices.nonnegative(obs, 3, 2).collect()}
    assert shifted[1, 1] == 1.0 and shifted[0, 0] == 4.5
    assert min(r.shifted for r in matrices.negate(obs, 3, 2).collect()) == 0.0
    matrices.write_sensitivity(obs, rows, ["d1", "d2"], str(tmp_path / "out"))
    back, _, _ = matrices.read_sensitivity(spark, str(tmp_path / "out"), sep="\t")
    assert sorted((r.i, r.j, r.r) for r in back.collect()) == got
    (tmp_path / "m.txt").write_text("1 2.5\n-3e2 NaN\n")
    assert sorted((r.i, r.j, r.r) for r in matrices.read_masked(spark, str(tmp_path / "m.txt"), " ").collect()) == [(0, 0, 1.0), (0, 1, 2.5), (1, 0, -300.0)]
    (tmp_path / "k.txt").write_text("a\tb\n1\t2\n3\t4\n")
    assert sorted((r.i, r.j, r.r) for r in matrices.read_kernel(spark, str(tmp_path / "k.txt")).collect())[-1] == (1, 1, 4.0)
    (tmp_path / "f.csv").write_text("n,a,b\nx,1,2\ny,3,4\n")
    assert sorted((r.i, r.j, r.r) for r in matrices.read_features(spark, str(tmp_path / "f.csv")).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    matrices.write_matrix([[1, 2], [3, 4.5]], str(tmp_path / "w.txt"))
    assert matrices.read_matrix(spark, str(tmp_path / "w.txt")).count() == 4


def test_trials_run_at_once(spark):
    from factorloom.operators.trials import run_trials

    def work(shared, trial):
        time.sleep(2)
        return {"was": trial["n"] + shared}

    run_trials(spark, 0, [{"n": 0}], work)  # a first worker
    began = time.time()
    out = run_trials(spark, 1, [{"n": k} for k in range(4)], work)
    assert [r["was"] for r in out] == [1, 2, 3, 4] and time.time() - began < 7
    with pytest.raises(ValueError, match="broadcast bound"):
        M_cells = Cells(*(np.zeros(1) for _ in range(3)), 1, 1)
        M_cells.r = np.broadcast_to(0.0, 60_000_000)
        run_trials(spark, M_cells, [{}], work)


def test_draws_depend_on_the_row_only(spark, toy):
    train, _ = toy
    model = lambda: Factorizer("gibbs", 2, None, Priors(rows=1.0, columns=1.0), "exp", seed=3)
    near = model().fit(*train.sides(), 3)
    sides = spark_sides(frame(spark, train).repartition(7), 30, 20)
    far = model().fit(*sides, 3)
    assert np.allclose(far.u, near.u) and np.allclose(far.v, near.v)
    for s in sides:
        s.close()


def test_numbers_of_rows_are_uniform_and_normal():
    from factorloom.functions.special import RowDraws, tn_draw, tn_moments

    draws = RowDraws((1, 2), np.arange(200_000))
    u, z = draws.random(), draws.standard_normal()
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002 and abs(z.mean()) < 0.01 and abs(z.var() - 1) < 0.02
    for no, (mu, tau) in enumerate(((1.0, 2.0), (-3.0, 1.0), (0.0, 4.0))):
        draws.begin(no)
        x = tn_draw(np.full(200_000, mu), np.full(200_000, tau), draws)
        mean, var = tn_moments(mu, tau)
        assert abs(x.mean() - mean) < 0.02 * mean and abs(x.var() - var) < 0.03 * var


def sparse(seed=1, n=40):
    """A matrix of which each column has one cell: no fold may be drawn freely."""
    rng = np.random.default_rng(seed)
    i = np.concatenate((np.arange(n), rng.integers(0, n, 2 * n)))
    j = np.concatenate((np.arange(n), rng.integers(0, n // 2, 2 * n)))
    cells = sorted(set(zip(i.tolist(), j.tolist())))
    i, j = np.array(cells).T
    return Cells(i, j, rng.random(len(i)), n, n)


def test_covering_splits(spark):
    cells = sparse()
    obs = frame(spark, cells).withColumn("_cover", F.lit(1)).withColumn("P", F.col("i"))
    with pytest.raises(ValueError, match="attempts"):
        M.try_folds(obs, 3, 5, 1)
    folded = M.covering_folds(obs, 3, 1)
    assert folded.count() == len(cells.r) and M.lost_lines(folded, "i").isEmpty() and M.lost_lines(folded, "j").isEmpty()
    sizes = [r["count"] for r in folded.where("fold >= 0").groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1 and folded.columns[:5] == ["i", "j", "r", "_cover", "P"]
    for f in range(3):
        assert M.covers(M.training(folded, f), 40, 40)
    parts = M.covering_split(obs, len(cells.r), 1, 0.2, 1)
    assert parts.where("split = 'train'").count() == int(len(cells.r) * 0.8) and M.covers(parts.where("split = 'train'"), 40, 40)
    with pytest.raises(ValueError, match="needed to cover"):
        M.covering_split(obs, len(cells.r), 1, 0.99, 1)
    mask = M.covering_mask(spark, 30, 20, 0.9, 5)
    assert mask.count() == 60 and M.covers(mask, 30, 20)
    fold = fold_numbers(cells, 3, 1)
    assert all(len(np.unique(at[fold != f])) == 40 for f in range(3) for at in (cells.i, cells.j)) and (fold >= 0).any()
    empty = M.covering_folds(obs.where("i > 99"), 3, 1)
    assert empty.count() == 0 and M.cover(spark.createDataFrame([(None, 1), (2, None)], "i long, j long"), 1).count() == 2


def test_masks_keep_all_columns(spark, toy):
    from factorloom.operators.metrics import global_metrics

    obs = frame(spark, toy[0]).withColumn("p", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("_BUCKET", F.lit(3))
    for made in (M.folds(obs, 2, 1), M.split(obs, 30, 20, 0.3, 1), M.round_robin(obs, 2, 1), M.folds_of(obs, "i", 5, 2, 1)):
        assert made.columns[:6] == obs.columns and made.where("p = 1 and _key = 2 and _bucket = 3").count() == len(toy[0].r)
    fit = Factorizer("icm", 2, None, Priors(), "random", seed=1).fit(*toy[0].sides(), 2)
    assert "p" in M.folds(fit.predicted(frame(spark, toy[0])), 2, 1).columns
    odd = spark.createDataFrame([(-1, 0, 1.0), (None, 0, 1.0), (30, 0, 1.0), (0, 99, 1.0), (1, 1, 1.0)], "i long, j long, r double")
    assert [r.p is None for r in fit.predicted(odd).collect()] == [True, True, True, True, False]
    assert fit.predict(odd)["MSE"] == pytest.approx((1 - float(fit.u[1] @ fit.v[1])) ** 2)
    found = global_metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (5.0, None), (None, 1.0)], "r double, p double")).first()
    assert (found.n, found.mse) == (2, 1.0)
    with pytest.raises(ValueError, match="numbered"):
        spark_sides(odd.where("i >= 0"), 30, 20)


def test_failed_and_nan_restarts_come_last():
    search = Search(Setup("icm"))
    row = lambda n, x: {"K": 1, "L": None, "restart": n, "loglikelihood": x, "MSE": 1.0}
    search._take([row(0, math.nan), row(1, -5.0), row(2, -3.0), {"K": 1, "L": None, "error": "x"}, row(3, math.nan)])
    assert search.results[1, None]["restart"] == 2
    with pytest.raises(ValueError, match="all trials failed"):
        Search(Setup("icm")).best_value("MSE")


def test_moments_merge_and_do_not_cancel():
    from factorloom.operators import kernels as K
    from factorloom.operators.metrics import from_sums

    rng = np.random.default_rng(1)
    r = rng.normal(size=10_000)
    p = r + rng.normal(size=10_000) * 0.5
    want = from_sums(K.cell_sums(r, p))
    for shift in (0.0, 1e8):
        x, y = r + shift, p + shift
        total = None
        for part in np.array_split(np.arange(10_000), 37):
            made = K.cell_sums(x[part], y[part])
            total = made if total is None else total + made
        total = total + K.cell_sums(r[:0], p[:0])
        exact = 1 - np.sum((x - y) ** 2) / np.sum((x - x.mean()) ** 2)
        assert from_sums(total)["R^2"] == pytest.approx(exact, rel=1e-9)
        assert from_sums(total)["Rp"] == pytest.approx(want["Rp"], rel=1e-6)
    assert math.isnan(from_sums(K.cell_sums(r[:0], p[:0]))["MSE"])


def test_kmeans_on_executors(spark):
    """The same clusters as in one process from equal centres, with points that have few cells and an empty cluster."""
    from factorloom.operators import kernels as K
    from factorloom.operators.kmeans import distances

    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(0, 0.3, (20, 6)) for c in (0.0, 10.0, 20.0)])
    i, j = np.nonzero(rng.random(x.shape) < 0.6)
    i, j = np.concatenate((i, np.arange(60))), np.concatenate((j, np.arange(60) % 6))
    i, j = np.array(sorted(set(zip(i.tolist(), j.tolist())))).T
    obs = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j)], "i long, j long, r double")
    sides = spark_sides(obs, 60, 6)
    centres = np.stack((np.full(6, 1.0), np.full(6, 9.0), np.full(6, 500.0)))
    found = [r.cluster for r in MaskedKMeans(3, 1).fit_table(*sides, centres).orderBy("idx").collect()]
    assert [len(set(found[k : k + 20])) for k in (0, 20, 40)] == [1, 1, 1] and len(set(found)) == 3
    drawn = MaskedKMeans(3, 3).fit_table(*sides)
    assert drawn.count() == 60 and drawn.columns == ["idx", "cluster"]
    with pytest.warns(UserWarning):
        MaskedKMeans(70, 1, passes=2).fit_table(*sides)
    for s in sides:
        s.close()
    # Distances touch cells only: a block of few cells and very many coordinates.
    wide = K.Block(np.arange(400), np.full(400, 5), rng.integers(0, 1_000_000, 2000), rng.random(2000))
    import tracemalloc

    centres, have = np.zeros((2, 1_000_000)), np.ones((2, 1_000_000))
    tracemalloc.start()
    d = distances(wide, centres, have)
    assert tracemalloc.get_traced_memory()[1] < 2_000_000 and d.shape == (400, 2)
    tracemalloc.stop()
