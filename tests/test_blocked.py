"""Fits in blocks against fits whose factors are broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import kernels as K
from factorloom.operators import sides
from factorloom.operators.blocked import BlockedFactorizer
from factorloom.operators.models import Cells, Factorizer, Priors, spark_sides
from factorloom.sources.synthetic import local_toy


@pytest.fixture(scope="module")
def toy():
    return local_toy(50, 30, 3, fraction=0.4, seed=4)[0]


@pytest.fixture(scope="module")
def obs(spark, toy):
    rows = [(int(i), int(j), float(r)) for i, j, r in zip(toy.i, toy.j, toy.r)]
    return spark.createDataFrame(rows, "i long, j long, r double").withColumn("b", F.lit(7)).persist()


def files(spark):
    """Entries in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    import os

    return set(os.listdir(base))


@pytest.mark.parametrize("method", ["np", "icm", "gibbs", "vb"])
@pytest.mark.parametrize("l", [None, 2])
def test_equal_to_fits_with_broadcast_factors(spark, toy, obs, method, l, monkeypatch):
    settings = dict(k=3, l=l, priors=Priors(rows=1.0, columns=0.5, middle=2.0), init="ones" if method == "np" else "exp", seed=3, joint=True)
    want = Factorizer(method, **settings).fit(*toy.sides(), 3)
    monkeypatch.setattr(sides, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError, match="broadcast bound"):
        far = spark_sides(obs, 50, 30)
        try:
            Factorizer(method, **settings).fit(*far, 1)
        finally:
            for s in far:
                s.close()
    got = BlockedFactorizer(method, **settings).fit_table(obs, 50, 30, 3, rows=8)
    for a, b in zip(got.history, want.history, strict=True):
        for m in ("MSE", "R^2", "Rp", "i_div", "elbo"):
            assert a[m] == pytest.approx(b[m], rel=1e-8)
    assert got.tau == pytest.approx(want.tau, rel=1e-8) and got.elbo == pytest.approx(want.elbo, rel=1e-8)
    u = np.array([r.vec for r in got.u.orderBy("idx").collect()])
    v = np.array([r.vec for r in got.v.orderBy("idx").collect()])
    assert np.allclose(u, want.u, rtol=1e-7) and np.allclose(v, want.v, rtol=1e-7)
    if l:
        assert np.allclose(got.s, want.s, rtol=1e-7)


def test_means_of_kept_samples_and_predictions(spark, toy, obs):
    settings = dict(k=2, l=2, priors=Priors(), init="exp", seed=3, thinned=(1, 2))
    want = Factorizer("gibbs", **settings).fit(*toy.sides(), 4)
    got = BlockedFactorizer("gibbs", **settings).fit_table(obs, 50, 30, 4, rows=16)
    u, v, s, _ = want.factors(1, 2)
    assert np.allclose(np.array([r.vec for r in got.u.orderBy("idx").collect()]), u)
    cells = obs.limit(20).union(spark.createDataFrame([(99, 0, 1.0, 1), (None, 0, 1.0, 1)], obs.schema))
    rows = got.predicted(cells).collect()
    assert len(rows) == 22 and sum(r.p is None for r in rows) == 2
    for r in rows:
        if r.p is not None:
            assert r.p == pytest.approx(float(u[r.i] @ s @ v[r.j]))


@pytest.mark.parametrize("method", ["np", "icm"])
def test_random_beginnings_do_not_depend_on_blocks(spark, obs, method):
    fits = [BlockedFactorizer(method, 2, init="random", seed=5).fit_table(obs, 50, 30, 2, rows=n) for n in (7, 64)]
    assert fits[0].history[-1]["MSE"] == pytest.approx(fits[1].history[-1]["MSE"], rel=1e-9)


def test_tables_are_deleted(spark, obs):
    BlockedFactorizer("icm", 2).fit_table(obs, 50, 30, 1)
    before = files(spark)
    BlockedFactorizer("vb", 2, 2).fit_table(obs, 50, 30, 2)
    assert len(files(spark) - before) == 2  # the two factors


def test_cases(spark, obs):
    with pytest.raises(ValueError, match="unobserved row"):
        BlockedFactorizer("icm", 2).fit_table(obs, 51, 30, 1)
    with pytest.raises(ValueError, match="priors"):
        BlockedFactorizer("icm", 2, priors=Priors(rows=np.ones((50, 2)))).fit_table(obs, 50, 30, 1)
    with pytest.raises(ValueError, match="kmeans"):
        BlockedFactorizer("icm", 2, 2, init="kmeans").fit_table(obs, 50, 30, 1)
    with pytest.raises(ValueError, match="Unknown initialisation"):
        BlockedFactorizer("icm", 2, init="bad").fit_table(obs, 50, 30, 1)


def test_joint_middle_update_never_raises_the_divergence(toy):
    """And both updates rest at the same middle factor."""
    rng = np.random.default_rng(2)
    toy = Cells(toy.i, toy.j, np.abs(toy.r) + 0.1, 50, 30)
    rows, _ = toy.sides()
    u, v = rng.random((50, 3)) + 0.1, rng.random((30, 2)) + 0.1
    rest = {}
    for joint in (True, False):
        s, last = np.ones((3, 2)), np.inf
        for n in range(3000):
            now = rows.sums(K.fit_sums, u @ s, v)[7]
            assert now <= last + 1e-9
            last = now
            if joint:
                sums = rows.sums(K.middle_joint, u, s, v)
                s = s * sums["top"] / sums["low"]
            else:
                s = rows.sums(K.middle_multiplicative, u, s, v)
        rest[joint] = last
    assert rest[True] == pytest.approx(rest[False], rel=1e-6)
    fit = Factorizer("np", 3, 2, init="random", seed=1, joint=True).fit(*toy.sides(), 30)
    falls = [h["i_div"] for h in fit.history]
    assert all(b <= a + 1e-9 for a, b in zip(falls, falls[1:]))
