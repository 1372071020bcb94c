import math

import numpy as np
import pytest

from factorloom.functions import special as sp
from factorloom.operators import kernels as K
from factorloom.operators.metrics import from_sums
from factorloom.operators.models import Cells, Factorizer, Fit, Priors
from factorloom.sources.synthetic import local_toy


def test_gamma_and_truncated_normal():
    assert sp.gamma_expectation_log(2, 3) == pytest.approx(-0.67582795356964265, abs=1e-12)
    assert sp.gamma_mode(2, 3) == pytest.approx(1 / 3) and sp.gamma_expectation(2, 3) == pytest.approx(2 / 3)
    mean, var = sp.tn_moments(-1.0, 2000.0)
    assert float(mean) == pytest.approx(1 / 2000) and float(var) == pytest.approx((1 / 2000) ** 2)
    # Against numeric integration.
    x = np.linspace(0, 30, 400001)
    for mu, tau in ((1.0, 3.0), (-2.0, 1.5), (0.0, 0.5)):
        w = np.exp(-tau / 2 * (x - mu) ** 2)
        m = (x * w).sum() / w.sum()
        mean, var = sp.tn_moments(mu, tau)
        assert float(mean) == pytest.approx(m, rel=1e-3) and float(var) == pytest.approx(((x - m) ** 2 * w).sum() / w.sum(), rel=1e-3)
    assert sp.tn_moments(np.nan, 1.0)[0] == 0 and sp.tn_expectation(1.0, 0.0) == 0 and sp.tn_mode(-1.0) == 0
    assert sp.log_half_erfc(30.0) == pytest.approx(-905.0 - math.log(2 * 30 * math.sqrt(math.pi)) + 5 - 1 / 1800, abs=1e-3)


@pytest.mark.parametrize("mu,tau", [(1.0, 1.0), (-3.0, 1.0), (-40.0, 2.0), (0.0, 10.0)])
def test_draws_have_the_moments(mu, tau):
    x = sp.tn_draw(np.full(200000, mu), np.full(200000, tau), np.random.default_rng(3))
    mean, var = sp.tn_moments(mu, tau)
    assert (x >= 0).all() and x.mean() == pytest.approx(float(mean), rel=0.02) and x.var() == pytest.approx(float(var), rel=0.05)


def test_two_sided_truncation():
    rng = np.random.default_rng(4)
    for a, b, mu, sigma in ((-1.0, 2.0, 0.5, 1.0), (3.0, 3.2, 0.0, 1.0), (4.0, np.inf, 0.0, 1.0), (-9.0, -7.0, 0.0, 1.0), (-np.inf, -2.0, 1.0, 2.0)):
        x, p = sp.truncated_normal(np.full(50000, a), b, mu, sigma, rng, density=True)
        assert (x >= a).all() and (x <= b).all() and (p > 0).all()
        g = np.linspace(max(a, -14), min(b, 14), 200001)
        w = np.exp(-0.5 * ((g - mu) / sigma) ** 2)
        assert x.mean() == pytest.approx((g * w).sum() / w.sum(), abs=0.02)
    assert sp.tn_draw(1.0, 0.0, rng) == 0
    with pytest.raises(ValueError):
        sp.truncated_normal(1.0, 1.0, 0.0, 1.0, rng)


R4, M4 = np.array([[1, 2, 0, 4], [5, 0, 7, 0]], float), np.array([[1, 1, 0, 1], [1, 0, 1, 0]])
U4, V4 = np.array([[1.0, 2], [3, 4]]), np.array([[5.0, 6], [7, 8], [9, 10], [11, 12]])


def dense_multiplicative(r, m, u, v, k):
    """The update of one factor k, as sums."""
    p = u @ v.T
    return [u[i, k] * sum(v[j, k] * r[i, j] / p[i, j] for j in range(r.shape[1]) if m[i, j]) / sum(v[j, k] for j in range(r.shape[1]) if m[i, j]) for i in range(len(u))]


def test_multiplicative_sweep_is_factor_by_factor():
    rows, columns = Cells.dense(R4, M4).sides()
    u = U4.copy()
    for k in range(2):
        u[:, k] = dense_multiplicative(R4, M4, u, V4, k)
    assert np.allclose(K.multiplicative(rows.block, U4, V4), u, rtol=1e-12)
    v = V4.copy()
    for k in range(2):
        v[:, k] = dense_multiplicative(R4.T, M4.T, v, U4, k)
    assert np.allclose(K.multiplicative(columns.block, V4, U4), v, rtol=1e-12)
    # One whole iteration, a value known in closed form.
    fit = Cells.dense(np.array([[8, 5], [20, 13]]), np.array([[1, 1], [1, 0]])).sides()
    x = K.multiplicative(fit[0].block, np.array([[10.0, 9], [8, 7]]), np.array([[6.0, 4], [5, 3]]))
    assert x[0, 0] == pytest.approx(10 * (6 * 8 / 96 + 5 * 5 / 77) / 11)


def constant(tri=False):
    r, m = np.ones((5, 3)), np.ones((5, 3))
    m[0, 0] = m[2, 2] = m[3, 1] = 0
    return Cells.dense(r, m)


def test_conditionals_of_constant_matrix():
    cells = constant()
    rows, columns = cells.sides()
    u, v, tau = np.full((5, 2), 1 / 2), np.full((3, 2), 1 / 3), 3.0
    sums = K.fit_sums(rows.block, u, v)
    assert 3 + sums[0] / 2 == 9 and 1 + sums[6] / 2 == pytest.approx(1 + 0.5 * 12 * (2 / 3) ** 2)
    seen = []
    g, b = rows.block.gram(v)
    K.scan(u.copy(), g, np.einsum("nkk->nk", g), b, np.full((5, 2), 2.0), tau, lambda mu, p, k: seen.append(p) or np.full(5, 0.5))
    assert np.allclose(seen[0], 3 * np.array([2, 3, 2, 2, 3]) / 9)
    # The tri-factorisation: F 1/2, S 1/3, G 1/5.
    f, s, g = np.full((5, 2), 1 / 2), np.full((2, 4), 1 / 3), np.full((3, 4), 1 / 5)
    sums = K.fit_sums(rows.block, f @ s, g)
    assert 1 + sums[6] / 2 == pytest.approx(1 + 0.5 * 12 * (11 / 15) ** 2)
    gram, _ = rows.block.gram(g @ s.T)
    assert np.allclose(3 * gram[:, 0, 0], 3 * np.array([32, 48, 32, 32, 48]) / 225)
    assert 3 * K.middle_sums(rows.block, f, g)["P"][0, 0] == pytest.approx(3 * 3 / 25)
    gram, _ = columns.block.gram(f @ s)
    assert np.allclose(3 * gram[:, 0, 0], 3 * 4 / 9)


def test_expected_errors():
    cells = constant()
    rows, _ = cells.sides()
    rng = np.random.default_rng(0)
    u, s, v, w = (rng.random(x) for x in ((5, 2), (5, 2), (3, 2), (3, 2)))
    m = np.zeros((5, 3))
    m[cells.i, cells.j] = 1
    want = (m * ((1 - u @ v.T) ** 2 + (s + u**2) @ (w + v**2).T - u**2 @ (v**2).T)).sum()
    assert K.expected_error(rows.block, u, s, v, w) == pytest.approx(want)
    # Tri: against draws of independent factors with these moments (normal, so any sign).
    f, fv, c, cv, g, gv = (rng.random(x) for x in ((5, 2), (5, 2), (2, 4), (2, 4), (3, 4), (3, 4)))
    draw = lambda a, b: a + np.sqrt(b) * rng.standard_normal((40000, *a.shape))
    p = np.einsum("nik,nkl,njl->nij", draw(f, fv), draw(c, cv), draw(g, gv))
    assert K.expected_error_tri(rows.block, f, fv, c, cv, g, gv) == pytest.approx((m * (1 - p) ** 2).sum((1, 2)).mean(), rel=0.1)


def test_variational_rows_maximise_the_bound():
    # Coordinate ascent: the bound never falls, for both models.
    for l in (None, 3):
        train, _ = local_toy(30, 20, 3, l, fraction=0.2, seed=2)
        fit = Factorizer("vb", 3, l, Priors(1, 1, 1.0, 1.0, 1.0), "random", seed=1).fit(*train.sides(), 40, train)
        bounds = [h["elbo"] for h in fit.history]
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:]))


def test_multiplicative_lowers_divergence():
    for l in (None, 3):
        train, _ = local_toy(30, 20, 3, l, tau=math.inf, fraction=0.2, seed=2)
        fit = Factorizer("np", 3, l, init="random", seed=1).fit(*train.sides(), 40, train)
        d = [h["i_div"] for h in fit.history]
        assert all(b <= a + 1e-9 for a, b in zip(d, d[1:])) and d[-1] < d[0] / 5


@pytest.mark.parametrize("method", ["np", "icm", "gibbs", "vb"])
@pytest.mark.parametrize("l", [None, 3])
def test_models_recover_the_matrix(method, l):
    train, test = local_toy(60, 40, 3, l, tau=100.0, fraction=0.2, seed=5)
    rate = 1.0 if method == "icm" else 0.1  # modes collapse where the first prediction is far too great
    fits = [Factorizer(method, 3, l, Priors(1, 1, rate, rate, rate), "random", seed=s, least=1e-3).fit(*train.sides(), 150, train, every=150) for s in range(3)]
    assert max(f.predict(test, **({"burn_in": 100, "thinning": 2} if method == "gibbs" else {}))["R^2"] for f in fits) > 0.9


def test_metrics():
    r, p = np.array([3.0, 4.0]), np.array([1220.0, 1342.0])
    out = from_sums(K.cell_sums(r, p))
    assert out["MSE"] == pytest.approx((1217**2 + 1338**2) / 2)
    assert out["Rp"] == pytest.approx(61 / (math.sqrt(0.5) * math.sqrt(7442)))
    assert out["R^2"] == pytest.approx(1 - (1217**2 + 1338**2) / 0.5)
    flat = from_sums(K.cell_sums(np.ones(3), np.array([1.0, 2, 3])))
    assert flat["R^2"] == math.inf and math.isnan(flat["Rp"])
    assert K.cell_sums(np.array([0.0]), np.array([2.0]))[7] == 2


def test_thinned_means_and_quality():
    m = np.arange(1, 11) ** 2
    fit = Fit(2, None, np.zeros((5, 2)), np.zeros((3, 2)), None, 0, 0, 12, samples={"u": [np.full((5, 2), 3.0 * x) for x in m], "v": [np.full((3, 2), 2.0 * x) for x in m], "tau": [float(x) for x in m]})
    u, v, _, tau = fit.factors(2, 3)
    assert tau == pytest.approx((9 + 36 + 81) / 3) and u[0, 0] == pytest.approx(126) and v[0, 0] == pytest.approx(84)
    cells = constant()
    fit = Fit(2, None, np.full((5, 2), 0.5), np.full((3, 2), 1 / 3), None, 3.0, math.log(3.0), 12)
    ll = 6 * (math.log(3) - math.log(2 * math.pi)) - 1.5 * 12 * (2 / 3) ** 2
    assert fit.quality("loglikelihood", cells) == pytest.approx(ll)
    assert fit.quality("AIC", cells) == pytest.approx(-2 * ll + 2 * 16)
    assert fit.quality("BIC", cells) == pytest.approx(-2 * ll + 16 * math.log(12))
    assert fit.quality("MSE", cells) == pytest.approx(4 / 9) and fit.quality("ELBO", cells) == 0
    with pytest.raises(ValueError, match="Unrecognised metric"):
        fit.quality("FAIL", cells)


def test_invalid_input():
    with pytest.raises(ValueError, match="two-dimensional"):
        Cells.dense(np.ones(3), np.ones(3))
    with pytest.raises(ValueError, match="same size"):
        Cells.dense(np.ones((3, 2)), np.ones((2, 3)))
    with pytest.raises(ValueError, match="row 1"):
        Cells.dense(np.ones((2, 3)), [[1, 1, 1], [0, 0, 0]]).check()
    with pytest.raises(ValueError, match="column 2"):
        Cells.dense(np.ones((2, 3)), [[1, 1, 0], [1, 0, 0]]).check()
    with pytest.raises(ValueError, match="wrong shape"):
        Priors(rows=np.ones((3, 1))).rate("rows", (2, 1))


def test_equal_seeds_give_equal_fits():
    train, _ = local_toy(20, 15, 2, 2, seed=1)
    for method in ("gibbs", "vb"):
        a, b = (Factorizer(method, 2, 2, init="random", seed=9).fit(*train.sides(), 5, train).history[-1]["MSE"] for _ in range(2))
        assert a == b
