"""Masked nonnegative matrix factorisation (R ~ U V') and tri-factorisation (R ~ F S G'), each by four methods:
multiplicative updates (np), iterated conditional modes (icm), Gibbs sampling (gibbs), variational Bayes (vb).

A model is fitted over two sides (rows and columns of the observed cells, see sides.py), in this process for many
small models at once or on executors for one large matrix. Iterations are a driver loop; nothing is chained into a
growing plan.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import exponential_draw, gamma_draw, gamma_expectation, gamma_expectation_log, gamma_mode, log_half_erfc, tn_draw, tn_moments
from . import kernels as K
from .kmeans import MaskedKMeans, one_hot
from .metrics import from_sums, global_metrics
from .sides import BROADCAST_BYTES, LocalSide, SparkSide, pack

METRICS = ("loglikelihood", "BIC", "AIC", "MSE", "ELBO")


@dataclass(frozen=True)
class Priors:
    """Gamma(alpha, beta) on the noise precision; exponential rates of the factors, a number or a matrix each."""

    alpha: float = 1.0
    beta: float = 1.0
    rows: float | np.ndarray = 0.1
    columns: float | np.ndarray = 0.1
    middle: float | np.ndarray = 0.1

    def rate(self, name: str, shape: tuple[int, int]) -> np.ndarray:
        value = np.asarray(getattr(self, name), float)
        if value.ndim and value.shape != shape:
            raise ValueError(f"Prior matrix of {name} has the wrong shape: {value.shape} instead of {shape}.")
        return np.broadcast_to(value, shape).astype(float)


@dataclass
class Cells:
    """Observed cells of an n_rows x n_columns matrix."""

    i: np.ndarray
    j: np.ndarray
    r: np.ndarray
    n_rows: int
    n_columns: int

    @classmethod
    def dense(cls, values, mask) -> Cells:
        values, mask = np.asarray(values, float), np.asarray(mask)
        if values.ndim != 2:
            raise ValueError(f"Input matrix R is not a two-dimensional array, but instead {values.ndim}-dimensional.")
        if values.shape != mask.shape:
            raise ValueError(f"Input matrix R is not of the same size as the indicator matrix M: {values.shape} and {mask.shape} respectively.")
        i, j = np.nonzero(mask)
        return cls(i, j, values[i, j], *values.shape)

    @classmethod
    def from_df(cls, obs: DataFrame, n_rows: int, n_columns: int, at_most: int = 20_000_000) -> Cells:
        """For matrices of at most so many cells; larger ones are fitted on executors."""
        rows = obs.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("r").cast("double")).limit(at_most + 1).toArrow()
        if rows.num_rows > at_most:
            raise ValueError(f"more than {at_most} cells: fit on executors instead")
        return cls(*(rows[c].to_numpy() for c in ("i", "j", "r")), n_rows, n_columns)

    def check(self) -> None:
        for what, n, at in (("row", self.n_rows, self.i), ("column", self.n_columns, self.j)):
            empty = np.flatnonzero(np.bincount(at, minlength=n) == 0)
            if len(empty):
                raise ValueError(f"Fully unobserved {what} in R, {what} {empty[0]}.")

    def sides(self, test: Cells | None = None) -> tuple[LocalSide, LocalSide]:
        """test: cells that are judged each time errors are computed."""
        out = []
        for a, b, n in (("i", "j", self.n_rows), ("j", "i", self.n_columns)):
            block, beside = (K.Block.of(getattr(c, a), getattr(c, b), c.r, n) if c is not None else None for c in (self, test))
            block.test = beside
            out.append(LocalSide(block))
        return tuple(out)


def check_numbers(obs: DataFrame, n_rows: int, n_columns: int) -> int:
    """Each row and column has a cell, and none has a number beyond the matrix. The number of cells."""
    cells, seen = 0, {}
    for what, c, n in (("row", "i", n_rows), ("column", "j", n_columns)):
        lines = obs.groupBy(c).agg(F.count("*").alias("cells"))
        found = seen[what] = lines.agg(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.sum("cells").alias("cells")).first()
        if found.low is not None and (found.low < 0 or found.high >= n):
            raise ValueError(f"A {what} of R is numbered {found.low if found.low < 0 else found.high}; {n} {what}s are numbered from 0 on.")
        cells = found.cells or 0
    for what, n in (("row", n_rows), ("column", n_columns)):
        if n != seen[what].n:
            raise ValueError(f"Fully unobserved {what} in R: {n - seen[what].n} of {n}.")
    return cells


def spark_sides(obs: DataFrame, n_rows: int, n_columns: int, fold: int | None = None) -> tuple[SparkSide, SparkSide]:
    """The two sides of a large matrix obs(i, j, r): packed once by row and once by column. fold: the cells whose column
    fold has this number are tested in each pass, and not trained on."""
    cells = check_numbers(obs if fold is None else obs.where(F.col("fold") != fold), n_rows, n_columns)
    tag = None if fold is None else "fold"
    return SparkSide(pack(obs, "i", "j", tag=tag, cells=cells), n_rows, fold=fold), SparkSide(pack(obs, "j", "i", tag=tag, cells=cells), n_columns, fold=fold)


@dataclass
class Fit:
    """A fitted model: factors, precision, history of training errors, and for Gibbs the sums of thinned samples."""

    k: int
    l: int | None
    u: np.ndarray
    v: np.ndarray
    s: np.ndarray | None
    tau: float
    log_tau: float
    n: int
    history: list[dict] = field(default_factory=list)
    elbo: float = 0.0
    samples: dict[str, list] = field(default_factory=dict)
    sums: dict = field(default_factory=dict)

    def factors(self, burn_in: int | None = None, thinning: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, float]:
        """The factors, or with burn_in and thinning the means of the kept samples burn_in, burn_in + thinning, ..."""
        if burn_in is not None and self.sums:
            if (burn_in, thinning) != self.sums["kept"]:
                raise ValueError(f"the sums of samples are those of burn_in, thinning = {self.sums['kept']}")
            mean = {k: x / self.sums["n"] for k, x in self.sums.items() if k not in ("kept", "n")}
            return mean["u"], mean["v"], mean.get("s"), float(mean["tau"])
        if burn_in is None or not self.samples:
            return self.u, self.v, self.s, self.tau
        mean = {k: np.mean(x[burn_in::thinning], axis=0) for k, x in self.samples.items()}
        return mean["u"], mean["v"], mean.get("s"), float(mean["tau"])

    def predictions(self, i, j, **kept) -> np.ndarray:
        u, v, s, _ = self.factors(**kept)
        return np.einsum("ck,ck->c", (u if s is None else u @ s)[i], v[j])

    def predict(self, cells: Cells | DataFrame, **kept) -> dict[str, float]:
        """MSE, R^2 and Rp on any cells, in this process or of a table."""
        if isinstance(cells, DataFrame):
            found = global_metrics(self.predicted(cells, **kept)).first()
            return {"MSE": math.nan if found.mse is None else found.mse, "R^2": found.r2, "Rp": found.rp}
        return from_sums(K.cell_sums(cells.r, self.predictions(cells.i, cells.j, **kept)))

    def predicted(self, obs: DataFrame, name: str = "p", **kept) -> DataFrame:
        """A table of cells (i, j, ...) with the prediction of each, on the executors; null for a row or column that the
        model lacks, or where i or j is null."""
        u, v, s, _ = self.factors(**kept)
        left = u if s is None else u @ s
        if left.nbytes + v.nbytes > BROADCAST_BYTES:
            raise ValueError(f"factors of {left.nbytes + v.nbytes} bytes exceed the broadcast bound of {BROADCAST_BYTES}")
        sent, at = obs.sparkSession.sparkContext.broadcast((left, v)), [obs.columns.index(c) for c in ("i", "j")]

        def run(batches):
            for b in batches:
                left, right = sent.value
                i, j = (b.column(c).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for c in at)
                known = (i >= 0) & (i < len(left)) & (j >= 0) & (j < len(right))
                p = np.einsum("ck,ck->c", left[np.where(known, i, 0)], right[np.where(known, j, 0)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64(), mask=~known)], [*b.schema.names, name])

        return obs.mapInArrow(run, T.StructType([*obs.schema.fields, T.StructField(name, T.DoubleType())]))

    def parameters(self) -> int:
        (rows, k), (columns, l) = self.u.shape, self.v.shape
        return rows * k + columns * l + (k * l if self.s is not None else 0)

    def quality(self, metric: str, cells: Cells, **kept) -> float:
        """Of the fit to its training cells: log-likelihood, AIC, BIC, MSE, ELBO (0 unless variational)."""
        if metric not in METRICS:
            raise ValueError(f"Unrecognised metric for model quality: {metric}.")
        if metric == "ELBO":
            return self.elbo
        return self.quality_of(metric, K.cell_sums(cells.r, self.predictions(cells.i, cells.j, **kept)), **kept)

    def quality_of(self, metric: str, sums: np.ndarray, **kept) -> float:
        """The same from the sums over the training cells."""
        if metric not in METRICS:
            raise ValueError(f"Unrecognised metric for model quality: {metric}.")
        if metric == "ELBO":
            return self.elbo
        tau = self.factors(**kept)[3]
        log_tau = self.log_tau if not self.samples else math.log(tau)
        likelihood = sums[0] / 2 * (log_tau - math.log(2 * math.pi)) - tau / 2 * sums[6]
        p = self.parameters()
        return {"loglikelihood": likelihood, "AIC": 2 * p - 2 * likelihood, "BIC": p * math.log(sums[0]) - 2 * likelihood, "MSE": sums[6] / sums[0]}[metric]


class Factorizer:
    """fit(sides) for one method ("np", "icm", "gibbs", "vb") and size: k, or k and l for the tri-factorisation.

    init: how each factor begins: "ones", "random" (uniform for np, else exponential with its rate), "exp" (the
    rate's mean), "exponential" (np: draws with rate expo_prior), "kmeans" (rows and columns of the tri model).
    thinned (burn_in, thinning): Gibbs keeps the sums of these samples only, not each sample.
    joint: the multiplicative update of the middle factor changes all its values at once, from sums of one pass over the
    cells, instead of one value after another. Like the other it never raises the divergence and rests at the same points.
    """

    def __init__(self, method: str, k: int, l: int | None = None, priors: Priors | None = None, init: str | None = None, init_middle: str | None = None, seed: int = 0, least: float = 0.0, expo_prior: float = 1.0, tau_init: float = 1.0, keep_samples: bool = True, thinned: tuple[int, int] | None = None, joint: bool = False):
        if method not in ("np", "icm", "gibbs", "vb"):
            raise ValueError(f"Unknown method: {method}.")
        self.method, self.k, self.l, self.priors, self.seed, self.least = method, k, l, priors or Priors(), seed, least
        self.thinned, self.joint = thinned, joint
        self.init, self.init_middle, self.expo_prior, self.tau_init, self.keep = init or ("ones" if method == "np" else "exp"), init_middle, expo_prior, tau_init, keep_samples
        self.rng = np.random.default_rng([seed, 17])

    # -- beginnings --

    def _start(self, kind: str, rate: np.ndarray) -> np.ndarray:
        if kind == "ones":
            return np.ones(rate.shape)
        if self.method == "np" and kind == "random":
            return self.rng.random(rate.shape)
        if kind in ("random", "exponential"):
            return exponential_draw(self.expo_prior if self.method == "np" else rate, self.rng, rate.shape)
        if kind == "exp":
            return 1.0 / rate
        raise ValueError(f"Unknown initialisation: {kind}.")

    def begin(self, rows, columns):
        k, l = self.k, self.l or self.k
        rate = {"u": self.priors.rate("rows", (rows.n, k)), "v": self.priors.rate("columns", (columns.n, l))}
        state = {}
        if self.init == "kmeans":
            if self.l is None:
                raise ValueError("kmeans begins the tri-factorisation only")
            offset = 0.0 if self.method == "vb" else 0.2
            for name, (points, coordinates, c) in {"u": (rows, columns, k), "v": (columns, rows, l)}.items():
                state[name] = one_hot(MaskedKMeans(c, self.seed).fit_sides(points, coordinates), c) + offset
        else:
            state = {name: self._start(self.init, rate[name]) for name in ("u", "v")}
        if self.l is not None:
            rate["s"] = self.priors.rate("middle", (k, l))
            state["s"] = self._start(self.init_middle or (self.init if self.init != "kmeans" else "ones" if self.method == "np" else "exp"), rate["s"])
        return state, rate

    # -- the loop --

    def fit(self, rows, columns, iterations: int, cells: Cells | None = None, every: int = 1) -> Fit:
        """every: errors are computed each so many iterations (and at the last); where the sides have test cells, their errors
        are those beginning with test_, from the same pass."""
        x, rate = self.begin(rows, columns)
        run = {"np": self._np, "icm": self._icm, "gibbs": self._icm, "vb": self._vb}[self.method]
        samples: dict[str, list] = {}
        fit = Fit(self.k, self.l, x["u"], x["v"], x.get("s"), 1.0, 0.0, 0, samples=samples)
        began = time.time()
        for now in run(x, rate, rows, columns, iterations):
            if self.method == "gibbs" and self.thinned:
                burn_in, thinning = self.thinned
                fit.sums = fit.sums or {"kept": self.thinned, "n": 0}
                if now["it"] >= burn_in and (now["it"] - burn_in) % thinning == 0:
                    fit.sums["n"] += 1
                    for name in ("u", "v", "s", "tau"):
                        if name in now:
                            fit.sums[name] = fit.sums.get(name, 0.0) + now[name]
            elif self.method == "gibbs" and self.keep:
                for name in ("u", "v", "s", "tau"):
                    if name in now:
                        samples.setdefault(name, []).append(np.copy(now[name]))
            if now["it"] % every == 0 or now["it"] == iterations - 1:
                both = now["sums"] if now.get("sums") is not None else rows.sums(K.fit_both, self._left(now), now["v"])
                fit.n = int(both["train"][0])
                tested = {f"test_{m}": x for m, x in from_sums(both["test"]).items()} if "test" in both else {}
                fit.history.append({"iteration": now["it"], "elapsed": time.time() - began, **from_sums(both["train"]), "i_div": float(both["train"][7]), "elbo": now.get("elbo", 0.0), **tested})
            fit.u, fit.v, fit.s, fit.tau, fit.log_tau, fit.elbo = now["u"], now["v"], now.get("s"), now.get("tau", 1.0), now.get("log_tau", 0.0), now.get("elbo", 0.0)
        return fit

    @staticmethod
    def _left(x) -> np.ndarray:
        return x["u"] @ x["s"] if x.get("s") is not None else x["u"]

    def _seen(self, x):
        """The other side's factors as each side sees them."""
        return (x["v"] @ x["s"].T, lambda: x["u"] @ x["s"]) if self.l is not None else (x["v"], lambda: x["u"])

    def _np(self, x, rate, rows, columns, iterations):
        for it in range(iterations):
            if self.l is not None:  # this method begins with the middle
                if self.joint:
                    sums = rows.sums(K.middle_joint, x["u"], x["s"], x["v"])
                    with np.errstate(all="ignore"):
                        x["s"] = x["s"] * sums["top"] / sums["low"]
                elif rows.whole:
                    x["s"] = rows.sums(K.middle_multiplicative, x["u"], x["s"], x["v"])
                else:
                    for k in range(self.k):
                        for l in range(self.l):
                            top, low = rows.sums(K.middle_ratio, x["u"], x["s"], x["v"], k, l)
                            x["s"][k, l] *= np.divide(top, low)
            seen, left = self._seen(x)
            x["u"] = rows.rows(K.multiplicative, x["u"], seen)
            x["v"] = columns.rows(K.multiplicative, x["v"], left())
            yield {**x, "it": it}

    def _icm(self, x, rate, rows, columns, iterations):
        gibbs = self.method == "gibbs"
        sums = rows.sums(K.fit_sums, self._left(x), x["v"])
        alpha = self.priors.alpha + sums[0] / 2
        beta = self.priors.beta + sums[6] / 2
        tau = gamma_expectation(alpha, beta) if gibbs else gamma_mode(alpha, beta)

        def side(where, own, other, lam, it, no):
            if gibbs:
                return where.rows(K.drawn, own, other, lam, tau, (self.seed, it, no))
            return where.rows(K.most_likely, own, other, lam, tau, self.least)

        for it in range(iterations):
            seen, left = self._seen(x)
            x["u"] = side(rows, x["u"], seen, rate["u"], it, 0)
            if self.l is not None:
                self._middle(x, rate["s"], rows.sums(K.middle_sums, x["u"], x["v"]), tau)
            x["v"] = side(columns, x["v"], left(), rate["v"], it, 1)
            sums = rows.sums(K.fit_both, self._left(x), x["v"])
            beta = self.priors.beta + sums["train"][6] / 2
            tau = gamma_draw(alpha, beta, self.rng) if gibbs else gamma_mode(alpha, beta)
            yield {**x, "it": it, "tau": tau, "log_tau": math.log(tau), "sums": sums}

    def _middle(self, x, rate, stats, tau) -> None:
        s, p, b, lam = x["s"].ravel().copy(), stats["P"], stats["b"], rate.ravel()
        for c in range(len(s)):
            precision = tau * p[c, c]
            if precision > 0:
                mu = (tau * (b[c] - p[c] @ s + p[c, c] * s[c]) - lam[c]) / precision
                s[c] = float(tn_draw(mu, precision, self.rng)) if self.method == "gibbs" else max(mu, 0.0, self.least)
            elif self.method == "gibbs":
                s[c] = 0.0
        x["s"] = s.reshape(x["s"].shape)

    def _vb(self, x, rate, rows, columns, iterations):
        tri = self.l is not None
        names = ("s", "u", "v") if tri else ("u", "v")
        mu, precision = {n: x[n].copy() for n in names}, {n: np.full(x[n].shape, float(self.tau_init)) for n in names}
        var = {}
        for n in names:
            x[n], var[n] = tn_moments(mu[n], precision[n])
        n_cells = int(rows.sums(K.fit_sums, self._left(x), x["v"])[0])
        alpha = self.priors.alpha + n_cells / 2

        def error():
            if tri:
                return rows.sums(K.expected_error_tri, x["u"], var["u"], x["s"], var["s"], x["v"], var["v"])
            return rows.sums(K.expected_error, x["u"], var["u"], x["v"], var["v"])

        beta = self.priors.beta + error() / 2
        for it in range(iterations):
            tau = alpha / beta
            if tri:
                self._middle_vb(x, var, mu, precision, rate["s"], rows.sums(K.middle_sums, x["u"], x["v"], var["u"], var["v"]), tau)
            for name, where, other in (("u", rows, "v"), ("v", columns, "u")):
                extra = (x["s"] if name == "u" else x["s"].T, var["s"] if name == "u" else var["s"].T, self.rng.permutation(x[name].shape[1])) if tri else ()
                out = where.rows(K.variational, x[name], x[other], var[other], rate[name], tau, *extra)
                x[name], var[name], mu[name], precision[name] = (np.ascontiguousarray(out[:, :, c]) for c in range(4))
            squares = error()
            beta = self.priors.beta + squares / 2
            tau, log_tau = gamma_expectation(alpha, beta), gamma_expectation_log(alpha, beta)
            elbo = self.bound(n_cells, squares, alpha, beta, {n: (rate[n], x[n], var[n], mu[n], precision[n]) for n in names})
            yield {**x, "it": it, "tau": tau, "log_tau": log_tau, "elbo": elbo}

    def _middle_vb(self, x, var, mu, precision, rate, stats, tau) -> None:
        s, v, m, p = x["s"].copy(), var["s"].copy(), mu["s"].copy(), precision["s"].copy()
        cross, b, total = stats["P"], stats["b"], stats["T"]
        k_n, l_n = s.shape
        for c in self.rng.permutation(k_n * l_n):
            k, l = divmod(int(c), l_n)
            p[k, l] = tau * total[c]
            others = cross[c] @ s.ravel() - cross[c, c] * s[k, l]
            others += stats["Q"][l, k] @ s[:, l] - stats["Q"][l, k, k] * s[k, l] + stats["W"][k, l] @ s[k] - stats["W"][k, l, l] * s[k, l]
            m[k, l] = (tau * (b[c] - others) - rate[k, l]) / p[k, l]
            mean, spread = tn_moments(m[k, l], p[k, l])
            s[k, l], v[k, l] = float(mean), float(spread)
        x["s"], var["s"], mu["s"], precision["s"] = s, v, m, p

    def bound(self, n: int, squares: float, alpha: float, beta: float, factors: dict) -> float:
        """The evidence lower bound; factors: rate, mean, variance, mu and precision of each."""
        return self.noise_bound(n, squares, alpha, beta) + sum(self.factor_bound(*f) for f in factors.values())

    def noise_bound(self, n: int, squares: float, alpha: float, beta: float) -> float:
        """What the cells and the precision contribute."""
        tau, log_tau = gamma_expectation(alpha, beta), gamma_expectation_log(alpha, beta)
        a, b = self.priors.alpha, self.priors.beta
        out = n / 2 * (log_tau - math.log(2 * math.pi)) - tau / 2 * squares
        out += a * math.log(b) - math.lgamma(a) + (a - 1) * log_tau - b * tau
        return out - (alpha * math.log(beta) - math.lgamma(alpha) + (alpha - 1) * log_tau - beta * tau)

    @staticmethod
    def factor_bound(rate, mean, var, mu, precision) -> float:
        """What a factor, or a part of it, contributes."""
        out = float((np.log(rate) - rate * mean).sum())
        out -= 0.5 * float(np.log(precision).sum()) - mean.size / 2 * math.log(2 * math.pi)
        out += float(log_half_erfc(-mu * np.sqrt(precision) / math.sqrt(2)).sum())
        return out + float((precision / 2 * (var + (mean - mu) ** 2)).sum())
