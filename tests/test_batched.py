"""Folds and sizes side by side on executors, against the same trials one by one in this process."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import sides, trials
from factorloom.operators.batched import FoldedMatrix
from factorloom.operators.models import Cells, Factorizer, Priors, spark_sides
from factorloom.operators.trials import GreedySearch, GridSearch, LineSearch, Setup, fold_numbers, greedy_search_cv, line_search_cv, matrix_cv, nested_cv
from factorloom.sources.synthetic import local_toy


@pytest.fixture(scope="module")
def toy():
    return local_toy(30, 20, 3, fraction=0.2, seed=4)[0]


@pytest.fixture(scope="module")
def both(spark, toy):
    """The matrix with folds, in this process and on executors."""
    fold = fold_numbers(toy, 3, 1)
    rows = [(int(i), int(j), float(r), int(f)) for i, j, r, f in zip(toy.i, toy.j, toy.r, fold)]
    far = FoldedMatrix(spark.createDataFrame(rows, "i long, j long, r double, fold int").withColumn("extra", F.lit("x")), 30, 20)
    yield toy, far
    far.close()


def close(a, b):
    return a == pytest.approx(b, rel=1e-6, nan_ok=True)


@pytest.mark.parametrize("method, tri", [("np", False), ("icm", True), ("vb", True), ("gibbs", False)])
def test_trials_equal_those_of_one_process(spark, both, method, tri):
    near, far = both
    setup = Setup(method, Priors(rows=1.0, columns=1.0, middle=1.0), "exp" if method != "np" else "ones", iterations=4, restarts=2, seed=1, burn_in=1 if method == "gibbs" else None, thinning=2)
    todo = [trials._trial(setup, k, 2 if tri else None, n, fold=f) for f in range(3) for k in (1, 2) for n in range(2)] + [trials._trial(setup, 2, 2 if tri else None, 0)]
    fold = fold_numbers(near, 3, 1)
    want = trials.run_trials(spark, (setup, near, fold), todo, trials._fit_trial)
    passes = far.passes
    for a, b in zip(far.run(setup, todo), want):
        assert {k: a[k] for k in ("K", "L", "fold", "restart") if k in b} == {k: b[k] for k in ("K", "L", "fold", "restart") if k in b}
        assert close(a["MSE"], b["MSE"]) and close(a["loglikelihood"], b["loglikelihood"]) and ("test" in a) == ("test" in b)
        if "test" in b:
            assert close(a["test"]["MSE"], b["test"]["MSE"]) and close(a["test"]["Rp"], b["test"]["Rp"])
    assert far.passes - passes < 40  # not one for each of 13 models


def test_searches_and_cross_validation(spark, both):
    near, far = both
    setup = Setup("icm", Priors(rows=1.0, columns=1.0, middle=1.0), "exp", iterations=1, seed=1)
    for make in (lambda: LineSearch(setup, [1, 2]), lambda: GridSearch(setup, [1, 2], [1, 2])):
        a, b = make().search(spark, far), make().search(spark, near)
        assert a.results.keys() == b.results.keys() and all(close(a.results[k]["AIC"], b.results[k]["AIC"]) for k in b.results)
    a, b = (GreedySearch(setup, [1, 2, 3], [1, 2]).search(spark, x, "AIC") for x in (far, near))
    assert a.results.keys() == b.results.keys() and a.best_value("AIC") == b.best_value("AIC")
    a, b = (line_search_cv(spark, x, setup, [1, 2], 3) for x in (far, near))
    assert a.chosen == b.chosen and close(a.average, b.average)
    a, b = (greedy_search_cv(spark, x, setup, [1, 2], [1, 2], 3) for x in (far, near))
    assert a.chosen == b.chosen and close(a.average, b.average)
    a, b = (matrix_cv(spark, x, setup, [{"K": 1}, {"K": 2, "L": 2}], 3) for x in (far, near))
    assert a.keys() == b.keys() and all(close(a[k]["MSE"], b[k]["MSE"]) for k in b)
    nested = nested_cv(spark, far, setup, [{"K": 1}, {"K": 2}], 3, 2)
    assert len(nested.performances) == 3 and np.isfinite(nested.average["MSE"])


def test_several_passes_where_factors_exceed_the_bound(spark, both, monkeypatch):
    _, far = both
    setup = Setup("icm", iterations=2, init="exp", seed=1)
    todo = [trials._trial(setup, 2, None, 0, fold=f) for f in range(3)]
    want = far.run(setup, todo)
    before = far.passes
    far.run(setup, todo)
    few = far.passes - before
    monkeypatch.setattr(sides, "BROADCAST_BYTES", 2000)
    before = far.passes
    assert [close(a["MSE"], b["MSE"]) for a, b in zip(far.run(setup, todo), want)] == [True] * 3 and far.passes - before > few
    monkeypatch.setattr(sides, "BROADCAST_BYTES", 200)
    with pytest.raises(ValueError, match="broadcast bound"):
        far.run(setup, todo)


def test_failures_and_cases(spark, both):
    _, far = both
    todo = [trials._trial(Setup("icm"), k, None, 0, fold=0) for k in (1, 2)]
    assert all("Unknown initialisation" in r["error"] for r in far.run(Setup("icm", init="bad"), todo))
    rows = [(0, 0, 1.0, 0), (0, 1, 2.0, 1), (1, 0, 3.0, 0), (1, 1, 4.0, 0)]
    folded = spark.createDataFrame(rows, "i long, j long, r double, fold int")
    with pytest.raises(ValueError, match="training part of fold 0, row 1"):
        FoldedMatrix(folded, 2, 2)
    with pytest.raises(ValueError, match="Fully unobserved row"):
        FoldedMatrix(folded, 3, 2)


def test_errors_on_test_cells_in_each_iteration(spark, both):
    near, far = both
    fold = fold_numbers(near, 3, 1)
    part = lambda keep: Cells(near.i[keep], near.j[keep], near.r[keep], 30, 20)
    train, test = part(fold != 1), part(fold == 1)
    for method in ("np", "icm", "gibbs", "vb"):
        model = lambda: Factorizer(method, 2, None, Priors(rows=1.0, columns=1.0), "exp" if method != "np" else "ones", seed=3)
        want = model().fit(*train.sides(test), 3)
        alone = model().fit(*train.sides(), 3)
        assert "test_MSE" not in alone.history[0] and [h["MSE"] for h in alone.history] == [h["MSE"] for h in want.history]
        assert close(want.history[-1]["test_MSE"], want.predict(test)["MSE"])
        far_sides = spark_sides(far.folded, 30, 20, fold=1)
        got = model().fit(*far_sides, 3)
        for s in far_sides:
            s.close()
        for a, b in zip(got.history, want.history):
            assert all(close(a[m], b[m]) for m in ("MSE", "test_MSE", "test_R^2", "test_Rp") if not math.isnan(b[m]))


def test_a_stopped_search_goes_on_where_it_was(spark, both, tmp_path):
    from factorloom.operators.trials import Logged

    near, far = both
    setup = Setup("icm", Priors(rows=1.0, columns=1.0, middle=1.0), "exp", iterations=1, restarts=2, seed=1)
    fold = fold_numbers(near, 3, 1)
    for name, cells, folds in (("near", near, fold), ("far", far, None)):
        path = str(tmp_path / name)
        whole = line_search_cv(spark, cells if name == "far" else Logged(spark, near, str(tmp_path / "whole"), "x", fold), setup, [1, 2], 3)
        log = Logged(spark, cells, path, name, folds, wave=3)
        real, calls = trials.run_trials, []

        def failing(*a, real=real, calls=calls):
            calls.append(a)
            if len(calls) == 3:
                raise KeyboardInterrupt
            return real(*a)

        if name == "near":
            trials.run_trials = failing
            try:
                with pytest.raises(KeyboardInterrupt):
                    line_search_cv(spark, log, setup, [1, 2], 3)
            finally:
                trials.run_trials = real
            assert log.ran == 6 == log.frame().count()
        again = Logged(spark, cells, path, name, folds, wave=5)
        got = line_search_cv(spark, again, setup, [1, 2], 3)
        assert got.chosen == whole.chosen and close(got.average, whole.average)
        rows = log.frame().collect()
        assert len(rows) == len({r.key for r in rows}) == 18 and log.ran + again.ran == 18  # 12 trials and 6 refits, none twice
        third = Logged(spark, cells, path, name, folds)
        assert close(line_search_cv(spark, third, setup, [1, 2], 3).average, got.average) and third.ran == 0
    nested = nested_cv(spark, Logged(spark, near, str(tmp_path / "nested"), "n", fold), setup, [{"K": 1}, {"K": 2}], 3, 2)
    assert len(nested.performances) == 3
    bad = Logged(spark, near, str(tmp_path / "bad"), "b", fold)
    assert all("error" in r for r in bad.run(Setup("icm", init="bad"), [trials._trial(setup, 1, None, 0)])) and bad.frame().first().error
