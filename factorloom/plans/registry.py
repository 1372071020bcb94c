"""The queries of the factorisation engine and their SQL. Doubles are rounded alike on both sides."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.special import tn_moments
from ..operators import kernels as K
from ..operators import masks as M
from ..operators.blocked import BlockedFactorizer
from ..operators.kmeans import centres_of, nearest
from ..operators.metrics import global_metrics, i_divergence
from ..operators.models import Cells, Factorizer, Fit, Priors, spark_sides
from ..operators.sides import SparkSide, pack
from ..operators.sweeps import convergence, missing_sweep, noise_sweep, summary, timing
from ..operators.tables import written
from ..operators.trials import GreedySearch, GridSearch, LineSearch, Search, Setup, averaged, greedy_search_cv, line_search_cv, matrix_cv, nested_cv
from ..sources.matrices import negate, nonnegative
from ..sources.synthetic import generate_nmf, generate_nmtf
from .relations import cells, obs_sql, observed

SEED, FOLDS, FRACTION = 42, 5, 0.3
_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def entry(spark, sf_dir):
    return _QUERIES["np_nmf_sweep_u"](spark, sf_dir)


def r6(c):
    return F.round(c, 6)


# --- factors that both sides can compute -----------------------------------------------------------------------------


def start_u(n: int, k: int) -> np.ndarray:
    i, c = np.meshgrid(np.arange(n), np.arange(k), indexing="ij")
    return 1 + ((i * 5 + c) % 7) / 10


def start_v(n: int, k: int) -> np.ndarray:
    j, c = np.meshgrid(np.arange(n), np.arange(k), indexing="ij")
    return 1 + ((j * 7 + c * 3) % 5) / 10


S = np.array([[0.5, 1.25], [2.0, 0.75]])
U = [f"(1 + ((i * 5 + {c}) % 7) / 10.0)" for c in (0, 1)]
V = [f"(1 + ((j * 7 + {c * 3}) % 5) / 10.0)" for c in (0, 1)]
#: The factors of one side as the other sees them through S.
H = [f"({S[c, 0]} * {V[0]} + {S[c, 1]} * {V[1]})" for c in (0, 1)]
W = [f"({S[0, c]} * {U[0]} + {S[1, c]} * {U[1]})" for c in (0, 1)]


def vectors(frame, name: str):
    return frame.select(F.col("idx").alias(name), *(r6(F.element_at("vec", c + 1)).alias(f"f{c}") for c in (0, 1)))


def side(spark, sf_dir, by: str):
    obs, n_i, n_j = observed(spark, sf_dir)
    return SparkSide(pack(obs, *(("i", "j") if by == "i" else ("j", "i"))), n_i if by == "i" else n_j, keep=False), n_i, n_j


def _np_sql(own: list[str], other: list[str], by: str) -> str:
    return f"""{obs_sql()}, x AS (SELECT {by} AS g, r, CAST({own[0]} AS DOUBLE) AS a, CAST({own[1]} AS DOUBLE) AS b, CAST({other[0]} AS DOUBLE) AS h, CAST({other[1]} AS DOUBLE) AS k FROM obs),
s0 AS (SELECT g, any_value(a) * sum(h * r / (a * h + b * k)) / sum(h) AS a1 FROM x GROUP BY g),
s1 AS (SELECT g, any_value(a1) AS a1, any_value(b) * sum(k * r / (a1 * h + b * k)) / sum(k) AS b1 FROM x JOIN s0 USING (g) GROUP BY g)
SELECT g AS {by}, round(a1, 6) AS f0, round(b1, 6) AS f1 FROM s1"""


def _icm_sql(own: list[str], other: list[str], by: str, tau: float = 0.5, rate: float = 0.1) -> str:
    return f"""{obs_sql()}, x AS (SELECT {by} AS g, r, CAST({own[0]} AS DOUBLE) AS a, CAST({own[1]} AS DOUBLE) AS b, CAST({other[0]} AS DOUBLE) AS h, CAST({other[1]} AS DOUBLE) AS k FROM obs),
m AS (SELECT g, any_value(b) AS b, sum(h * h) AS hh, sum(h * k) AS hk, sum(k * k) AS kk, sum(r * h) AS rh, sum(r * k) AS rk FROM x GROUP BY g),
s0 AS (SELECT *, greatest(0, ({tau} * (rh - hk * b) - {rate}) / ({tau} * hh)) AS a1 FROM m)
SELECT g AS {by}, round(a1, 6) AS f0, round(greatest(0, ({tau} * (rk - hk * a1) - {rate}) / ({tau} * kk)), 6) AS f1 FROM s0"""


def _sweep(spark, sf_dir, by, fn, *more):
    x, n_i, n_j = side(spark, sf_dir, by)
    u, v = start_u(n_i, 2), start_v(n_j, 2)
    own, other = (u, v) if by == "i" else (v, u)
    extra = [np.full(own.shape, m) if k == 0 and fn is K.most_likely else m for k, m in enumerate(more)]
    return x, own, other, u, v, extra


# --- relations, shifts, coverage ---------------------------------------------------------------------------------------


@query("SELECT o_custkey AS a, p_brand AS b, round(avg(l_quantity), 6) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def obs_matrix(spark, sf_dir):
    return cells(spark, sf_dir, "cb").select("a", "b", r6("r").alias("r"))


@query(f"{obs_sql()} SELECT i, j, round(r - ((SELECT CASE WHEN any_value(n) < any_value(n_i) * any_value(n_j) THEN least(min(r), 0) ELSE min(r) END FROM obs, meta) - 1), 6) AS shifted FROM obs")
def nonneg_shift(spark, sf_dir):
    return nonnegative(*observed(spark, sf_dir)).select("i", "j", r6("shifted").alias("shifted"))


@query(f"{obs_sql()} SELECT i, j, round(-r - (SELECT CASE WHEN any_value(n) < any_value(n_i) * any_value(n_j) THEN least(min(-r), 0) ELSE min(-r) END FROM obs, meta), 6) AS shifted FROM obs")
def negate_shift(spark, sf_dir):
    return negate(*observed(spark, sf_dir)).select("i", "j", r6("shifted").alias("shifted"))


@query(f"{obs_sql()} SELECT i, count(*) AS cells FROM obs GROUP BY i")
def coverage_rows(spark, sf_dir):
    return M.coverage(observed(spark, sf_dir)[0], "i")


@query(f"{obs_sql()} SELECT j, count(*) AS cells FROM obs GROUP BY j")
def coverage_cols(spark, sf_dir):
    return M.coverage(observed(spark, sf_dir)[0], "j")


@query(f"{obs_sql()} SELECT f.j AS below, (SELECT count(DISTINCT i) FROM obs WHERE j < f.j) = (SELECT n_i FROM meta) AND f.j >= (SELECT n_j FROM meta) AS covered FROM (SELECT unnest([1, 5, 10, 25]) AS j) f")
def covers_check(spark, sf_dir):
    """Whether the cells of the first columns cover all rows and columns."""
    obs, n_i, n_j = observed(spark, sf_dir)
    return spark.createDataFrame([(n, M.covers(obs.where(F.col("j") < n), n_i, n_j)) for n in (1, 5, 10, 25)], "below int, covered boolean")


@query(f"{obs_sql()} SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS indices FROM obs GROUP BY i")
def row_index_lists(spark, sf_dir):
    return M.index_lists(observed(spark, sf_dir)[0], "i", "j").select("i", F.array_join("indices", ",").alias("indices"))


@query(f"{obs_sql('sb')} SELECT j, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS indices FROM obs GROUP BY j")
def col_index_lists(spark, sf_dir):
    return M.index_lists(observed(spark, sf_dir, "sb")[0], "j", "i").select("j", F.array_join("indices", ",").alias("indices"))


# --- masks and folds -----------------------------------------------------------------------------------------------------

_RANK = f"row_number() OVER (ORDER BY md5('{SEED}|' || CAST(i AS VARCHAR) || '|' || CAST(j AS VARCHAR)), i, j) - 1 AS p"


@query(f"WITH g AS (SELECT id // 120 AS i, id % 120 AS j FROM range(0, 24000) t(id)), k AS (SELECT i, j, {_RANK} FROM g) SELECT i, j FROM k WHERE p >= {int(24000 * FRACTION)}")
def mask_fraction(spark, sf_dir):
    return M.random_mask(spark, 200, 120, FRACTION, SEED)


@query(f"{obs_sql()}, k AS (SELECT i, j, r, {_RANK} FROM obs) SELECT i, j, round(r, 6) AS r, CASE WHEN p < CAST(floor(n_i * n_j * (1 - {FRACTION})) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM k, meta")
def train_test_split(spark, sf_dir):
    return M.split(*observed(spark, sf_dir), FRACTION, SEED).select("i", "j", r6("r").alias("r"), "split")


_FOLD = f"CAST(((p + 1) * {FOLDS} - 1) // m AS INTEGER)"
_FOLDED = f"k AS (SELECT i, j, {_RANK} FROM obs), folded AS (SELECT i, j, CAST(((p + 1) * {FOLDS} - 1) // n AS INTEGER) AS fold FROM k, meta)"


@query(f"{obs_sql()}, {_FOLDED} SELECT i, j, fold FROM folded")
def kfold_assign(spark, sf_dir):
    return M.folds(observed(spark, sf_dir)[0], FOLDS, SEED).select("i", "j", "fold")


_FEW = f"few AS (SELECT i, j FROM obs WHERE j < 3), k AS (SELECT i, j, {_RANK} FROM few), folded AS (SELECT i, j, CAST(((p + 1) * {FOLDS} - 1) // (SELECT count(*) FROM few) AS INTEGER) AS fold FROM k)"


@query(f"{obs_sql()}, {_FEW} SELECT 'i' AS axis, i AS line, min(fold) AS fold, count(*) AS cells FROM folded GROUP BY i HAVING min(fold) = max(fold) UNION ALL SELECT 'j', j, min(fold), count(*) FROM folded GROUP BY j HAVING min(fold) = max(fold)")
def fold_coverage(spark, sf_dir):
    """Of the first three columns alone: many rows have all their cells in one fold."""
    folded = M.folds(observed(spark, sf_dir)[0].where("j < 3"), FOLDS, SEED)
    lost = [M.lost_lines(folded, x).select(F.lit(x).alias("axis"), F.col(x).alias("line"), "fold", "cells") for x in ("i", "j")]
    return lost[0].union(lost[1])


def _axis_sql(axis: str, first: int) -> str:
    return f"""{obs_sql()}, inside AS (SELECT * FROM obs WHERE {axis} < {first}), k AS (SELECT i, j, {_RANK} FROM inside), m AS (SELECT count(*) AS m FROM inside)
SELECT i, j, {_FOLD} AS fold FROM k, m UNION ALL SELECT i, j, -1 FROM obs WHERE {axis} >= {first}"""


@query(_axis_sql("i", 50))
def kfold_rows(spark, sf_dir):
    return M.folds_of(observed(spark, sf_dir)[0], "i", 50, FOLDS, SEED).select("i", "j", "fold")


@query(_axis_sql("j", 10))
def kfold_cols(spark, sf_dir):
    return M.folds_of(observed(spark, sf_dir)[0], "j", 10, FOLDS, SEED).select("i", "j", "fold")


@query(f"{obs_sql()}, {_FOLDED} SELECT i, j FROM folded WHERE fold <> 2")
def train_masks(spark, sf_dir):
    return M.training(M.folds(observed(spark, sf_dir)[0], FOLDS, SEED), 2).select("i", "j")


@query(f"{obs_sql()} SELECT rk.i, ck.j FROM rk CROSS JOIN ck ANTI JOIN obs ON obs.i = rk.i AND obs.j = ck.j")
def mask_complement(spark, sf_dir):
    return M.complement(*observed(spark, sf_dir))


@query(f"{obs_sql()}, seen AS (SELECT i, j FROM obs WHERE (i + j) % 3 <> 0), means AS (SELECT j, avg(r) AS p FROM obs GROUP BY j) SELECT o.i, o.j, round(o.r, 6) AS r, round(p, 6) AS p FROM obs o ANTI JOIN seen USING (i, j) JOIN means USING (j)")
def recover_predictions(spark, sf_dir):
    obs = observed(spark, sf_dir)[0]
    predicted = obs.join(obs.groupBy("j").agg(F.avg("r").alias("p")), "j").select("i", "j", "p")
    return M.recover_predictions(obs.where((F.col("i") + F.col("j")) % 3 != 0), obs, predicted).select("i", "j", r6("r").alias("r"), r6("p").alias("p"))


@query(f"{obs_sql()}, k AS (SELECT i, j, {_RANK} FROM obs) SELECT i, j, CAST(p % {FOLDS} AS INTEGER) AS fold FROM k")
def kfold_round_robin(spark, sf_dir):
    return M.round_robin(observed(spark, sf_dir)[0], FOLDS, SEED).select("i", "j", "fold")


# --- metrics -------------------------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT r, avg(r) OVER (PARTITION BY i) AS p FROM obs)"


def _pairs(spark, sf_dir):
    obs = observed(spark, sf_dir)[0]
    return obs.join(obs.groupBy("i").agg(F.avg("r").alias("p")), "i").select("r", "p")


@query(f"""{obs_sql()}, {_PAIRS}, c AS (SELECT r, p, r - (SELECT avg(r) FROM pairs) AS dr, p - (SELECT avg(p) FROM pairs) AS dp FROM pairs)
SELECT count(*) AS n, round(avg((r - p) ** 2), 6) AS mse, round(1 - sum((r - p) ** 2) / sum(dr * dr), 6) AS r2, round(sum(dr * dp) / sqrt(sum(dr * dr) * sum(dp * dp)), 6) AS rp FROM c""")
def metrics_global(spark, sf_dir):
    return global_metrics(_pairs(spark, sf_dir)).select("n", *(r6(c).alias(c) for c in ("mse", "r2", "rp")))


@query(f"""{obs_sql()}, pairs AS (SELECT r + 1e8 AS r, avg(r) OVER (PARTITION BY i) + 1e8 AS p FROM obs), held AS (SELECT r, p FROM pairs WHERE floor(r) % 5 <> 0), c AS (SELECT r, p, r - (SELECT avg(r) FROM held) AS dr, p - (SELECT avg(p) FROM held) AS dp FROM held)
SELECT count(*) AS n, round(avg((r - p) ** 2), 5) AS mse, round(1 - sum((r - p) ** 2) / sum(dr * dr), 5) AS r2, round(sum(dr * dp) / sqrt(sum(dr * dr) * sum(dp * dp)), 5) AS rp FROM c""")
def metrics_shifted(spark, sf_dir):
    """Values far from zero, some of which have no prediction."""
    pairs = _pairs(spark, sf_dir).select((F.col("r") + 1e8).alias("r"), (F.col("p") + 1e8).alias("p"))
    pairs = pairs.withColumn("p", F.when(F.floor("r") % 5 != 0, F.col("p")))
    return global_metrics(pairs).select("n", *(F.round(c, 5).alias(c) for c in ("mse", "r2", "rp")))


@query(f"{obs_sql()}, {_PAIRS} SELECT round(sum(CASE WHEN r > 0 THEN r * ln(r / p) - r + p ELSE p END), 4) AS i_div FROM pairs")
def i_div(spark, sf_dir):
    return i_divergence(_pairs(spark, sf_dir)).select(F.round("i_div", 4).alias("i_div"))


_LL = "(n / 2.0 * (ln(0.05) - ln(2 * pi())) - 0.05 / 2 * se)"


@query(f"""{obs_sql()}, {_PAIRS}, s AS (SELECT (SELECT n FROM meta) AS n, (SELECT n_i + n_j FROM meta) AS k, sum((r - p) ** 2) AS se FROM pairs)
SELECT round({_LL}, 3) AS loglikelihood, round(2 * k - 2 * {_LL}, 3) AS aic, round(k * ln(n) - 2 * {_LL}, 3) AS bic, round(se / n, 6) AS mse FROM s""")
def quality_ic(spark, sf_dir):
    """Of a model with one factor, whose rows are the rows' means."""
    _, n_i, n_j = observed(spark, sf_dir)
    found = _pairs(spark, sf_dir).agg(F.count("*").alias("n"), F.sum((F.col("r") - F.col("p")) ** 2).alias("se")).first()
    shapes = [np.broadcast_to(np.nan, (n, 1)) for n in (n_i, n_j)]  # of the factors only the numbers of parameters count
    fit = Fit(1, None, *shapes, None, 0.05, math.log(0.05), found.n)
    sums = K.Moments(found.n, 0.0, 0.0, 0.0, 0.0, 0.0, found.se, 0.0)
    return spark.createDataFrame([tuple(round(float(fit.quality_of(m, sums)), d) for m, d in (("loglikelihood", 3), ("AIC", 3), ("BIC", 3), ("MSE", 6)))], "loglikelihood double, aic double, bic double, mse double")


@query(f"""{obs_sql()}, p AS (SELECT r, CAST({U[0]} AS DOUBLE) * {V[0]} + CAST({U[1]} AS DOUBLE) * {V[1]} AS p FROM obs WHERE (i + j) % 4 = 0), c AS (SELECT r, p, r - (SELECT avg(r) FROM p) AS dr, p - (SELECT avg(p) FROM p) AS dp FROM p)
SELECT round(avg((r - p) ** 2), 6) AS mse, round(1 - sum((r - p) ** 2) / sum(dr * dr), 6) AS r2, round(sum(dr * dp) / sqrt(sum(dr * dr) * sum(dp * dp)), 6) AS rp FROM c""")
def predict_test_cells(spark, sf_dir):
    """Errors of a model's predictions on cells of a table."""
    obs, n_i, n_j = observed(spark, sf_dir)
    found = Fit(2, None, start_u(n_i, 2), start_v(n_j, 2), None, 1.0, 0.0, 0).predict(obs.where((F.col("i") + F.col("j")) % 4 == 0))
    return spark.createDataFrame([tuple(round(float(found[m]), 6) for m in ("MSE", "R^2", "Rp"))], "mse double, r2 double, rp double")


# --- one sweep of each method ----------------------------------------------------------------------------------------------


@query(_np_sql(U, V, "i"))
def np_nmf_sweep_u(spark, sf_dir):
    x, own, other, *_ = _sweep(spark, sf_dir, "i", K.multiplicative)
    return vectors(x.frame(K.multiplicative, own, other), "i")


@query(_np_sql(V, U, "j"))
def np_nmf_sweep_v(spark, sf_dir):
    x, own, other, *_ = _sweep(spark, sf_dir, "j", K.multiplicative)
    return vectors(x.frame(K.multiplicative, own, other), "j")


@query(_np_sql(U, H, "i"))
def np_nmtf_f_sweep(spark, sf_dir):
    x, own, _, u, v, _ = _sweep(spark, sf_dir, "i", K.multiplicative)
    return vectors(x.frame(K.multiplicative, own, v @ S.T), "i")


@query(_np_sql(V, W, "j"))
def np_nmtf_g_sweep(spark, sf_dir):
    x, own, _, u, v, _ = _sweep(spark, sf_dir, "j", K.multiplicative)
    return vectors(x.frame(K.multiplicative, own, u @ S), "j")


@query(f"""{obs_sql()}, x AS (SELECT r, CAST({U[0]} AS DOUBLE) AS a, CAST({U[1]} AS DOUBLE) AS b, CAST({V[0]} AS DOUBLE) AS g, CAST({V[1]} AS DOUBLE) AS h FROM obs)
SELECT round({S[0, 1]} * sum(r * a * h / (a * ({S[0, 0]} * g + {S[0, 1]} * h) + b * ({S[1, 0]} * g + {S[1, 1]} * h))) / sum(a * h), 6) AS s01 FROM x""")
def np_nmtf_s_step(spark, sf_dir):
    x, _, _, u, v, _ = _sweep(spark, sf_dir, "i", K.multiplicative)
    top, low = x.sums(K.middle_ratio, u, S, v, 0, 1)
    return spark.createDataFrame([(round(float(S[0, 1] * top / low), 6),)], "s01 double")


@query(_icm_sql(U, V, "i"))
def icm_nmf_sweep_u(spark, sf_dir):
    x, own, other, _, _, more = _sweep(spark, sf_dir, "i", K.most_likely, 0.1, 0.5, 0.0)
    return vectors(x.frame(K.most_likely, own, other, *more), "i")


@query(_icm_sql(V, U, "j"))
def icm_nmf_sweep_v(spark, sf_dir):
    x, own, other, _, _, more = _sweep(spark, sf_dir, "j", K.most_likely, 0.1, 0.5, 0.0)
    return vectors(x.frame(K.most_likely, own, other, *more), "j")


@query(_icm_sql(U, H, "i"))
def icm_nmtf_f(spark, sf_dir):
    x, own, _, u, v, more = _sweep(spark, sf_dir, "i", K.most_likely, 0.1, 0.5, 0.0)
    return vectors(x.frame(K.most_likely, own, v @ S.T, *more), "i")


@query(_icm_sql(V, W, "j"))
def icm_nmtf_g(spark, sf_dir):
    x, own, _, u, v, more = _sweep(spark, sf_dir, "j", K.most_likely, 0.1, 0.5, 0.0)
    return vectors(x.frame(K.most_likely, own, u @ S, *more), "j")


_T = ["a * g", "a * h", "b * g", "b * h"]
_PS = ", ".join(f"sum({x} * {y}) AS p{m}{n}" for m, x in enumerate(_T) for n, y in enumerate(_T) if m <= n) + ", " + ", ".join(f"sum(r * {x}) AS b{m}" for m, x in enumerate(_T))


def _s_sql() -> str:
    p = lambda m, n: f"p{min(m, n)}{max(m, n)}"
    out, now = [], [str(x) for x in S.ravel()]
    for c in range(4):
        others = " + ".join(f"{p(c, d)} * {now[d]}" for d in range(4) if d != c)
        out.append(f"s{c} AS (SELECT *, greatest(0, (0.5 * (b{c} - ({others})) - 0.1) / (0.5 * p{c}{c})) AS n{c} FROM {'m' if c == 0 else f's{c - 1}'})")
        now[c] = f"n{c}"
    return ", ".join(out)


@query(f"{obs_sql()}, x AS (SELECT r, CAST({U[0]} AS DOUBLE) AS a, CAST({U[1]} AS DOUBLE) AS b, CAST({V[0]} AS DOUBLE) AS g, CAST({V[1]} AS DOUBLE) AS h FROM obs), m AS (SELECT {_PS} FROM x), {_s_sql()} SELECT round(n0, 5) AS s00, round(n1, 5) AS s01, round(n2, 5) AS s10, round(n3, 5) AS s11 FROM s3")
def icm_nmtf_s(spark, sf_dir):
    x, _, _, u, v, _ = _sweep(spark, sf_dir, "i", K.most_likely, 0.1, 0.5, 0.0)
    state = {"s": S.copy()}
    Factorizer("icm", 2, 2)._middle(state, np.full((2, 2), 0.1), x.sums(K.middle_sums, u, v), 0.5)
    return spark.createDataFrame([tuple(round(float(s), 5) for s in state["s"].ravel())], "s00 double, s01 double, s10 double, s11 double")


@query(f"{obs_sql()}, s AS (SELECT count(*) AS n, sum((r - ({U[0]} * {V[0]} + {U[1]} * {V[1]})) ** 2) AS se FROM obs) SELECT round((1 + n / 2.0 - 1) / (1 + se / 2), 6) AS tau FROM s")
def icm_tau_mode(spark, sf_dir):
    x, _, _, u, v, _ = _sweep(spark, sf_dir, "i", K.most_likely, 0.1, 0.5, 0.0)
    sums = x.sums(K.fit_sums, u, v)
    return spark.createDataFrame([(round(float((1 + sums[0] / 2 - 1) / (1 + sums[6] / 2)), 6),)], "tau double")


@query(f"""{obs_sql()}, x AS (SELECT r, CAST({U[0]} AS DOUBLE) AS a, CAST({U[1]} AS DOUBLE) AS b, CAST({V[0]} AS DOUBLE) AS g, CAST({V[1]} AS DOUBLE) AS h FROM obs)
SELECT round(sum((r - a * g - b * h) ** 2 + (a / 2 + a * a) * (g / 4 + g * g) + (b / 2 + b * b) * (h / 4 + h * h) - a * a * g * g - b * b * h * h), 3) AS esd FROM x""")
def vb_exp_square_diff(spark, sf_dir):
    x, _, _, u, v, _ = _sweep(spark, sf_dir, "i", K.most_likely, 0.1, 0.5, 0.0)
    return spark.createDataFrame([(round(x.sums(K.expected_error, u, u / 2, v, v / 4), 3),)], "esd double")


# erfc by the Maclaurin series of erf; |x| stays below 3.
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(abs(z) + 1e-300) - lgamma(n + 1)) / (2 * n + 1))) * sign(z)"


# The mean of a truncated normal; five deviations above zero the truncation is below the rounding.
_Z = "(-{mu} * sqrt({prec}) / sqrt(2))"
_TN = "CASE WHEN {mu} * sqrt({prec}) > 5 THEN {mu} ELSE {mu} + exp(-{mu} * {mu} * {prec} / 2) / sqrt(2 * pi() * {prec}) / (0.5 * (1 - " + _ERF.replace("(z)", f"({_Z})") + ")) END"


@query(f"""WITH g AS (SELECT id, CAST(id % 13 - 4 AS DOUBLE) / 4 AS mu, CAST(1 + id % 5 AS DOUBLE) / 2 AS tau FROM range(0, 65) t(id)), x AS (SELECT *, 1 / sqrt(tau) AS s, -mu * sqrt(tau) AS x, -mu * sqrt(tau) / sqrt(2) AS z FROM g),
h AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) / (0.5 * (1 - {_ERF})) AS l FROM x)
SELECT id, round(mu + s * l, 6) AS mean, round(s * s * (1 - l * (l - x)), 6) AS var FROM h
UNION ALL SELECT id, round(1 / ((40.0 + id) * tau), 6), round((1 / ((40.0 + id) * tau)) ** 2, 6) FROM (SELECT id, CAST(1 + id % 5 AS DOUBLE) / 2 AS tau FROM range(65, 95) t(id)) WHERE (40.0 + id) * sqrt(tau) > 30
UNION ALL SELECT id, 0, 0 FROM range(95, 100) t(id)""")
def tn_moments_table(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            n = b.column(0).to_numpy()
            # Ids from 65 on: far in the tail; from 95 on: no precision.
            mean, var = tn_moments(np.where(n < 65, (n % 13 - 4) / 4, -40.0 - n), np.where(n < 95, (1 + n % 5) / 2, 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean), pa.array(var)], ["id", "mean", "var"])

    return spark.range(100).mapInArrow(run, "id bigint, mean double, var double").select("id", r6("mean").alias("mean"), r6("var").alias("var"))


_VBS = ["0.5 * (rh - hk * b) - 0.1", "0.5 * (rk - hk * m0) - 0.1"]
_VB = f"""{obs_sql()}, x AS (SELECT i AS g, r, CAST({U[0]} AS DOUBLE) AS a, CAST({U[1]} AS DOUBLE) AS b, CAST({V[0]} AS DOUBLE) AS h, CAST({V[1]} AS DOUBLE) AS k FROM obs),
m AS (SELECT g, any_value(b) AS b, sum(h * h + h / 4) AS hh, sum(h * k) AS hk, sum(k * k + k / 4) AS kk, sum(r * h) AS rh, sum(r * k) AS rk FROM x GROUP BY g),
s0 AS (SELECT *, ({_VBS[0]}) / (0.5 * hh) AS mu0, 0.5 * hh AS prec0 FROM m),
t0 AS (SELECT *, {_TN.format(mu="mu0", prec="prec0")} AS m0 FROM s0),
s1 AS (SELECT *, ({_VBS[1]}) / (0.5 * kk) AS mu1, 0.5 * kk AS prec1 FROM t0)
SELECT g AS i, round(prec0, 6) AS prec0, round(mu0, 5) AS mu0, round(m0, 4) AS mean0, round(prec1, 6) AS prec1, round(mu1, 5) AS mu1, round({_TN.format(mu="mu1", prec="prec1")}, 4) AS mean1 FROM s1"""


@query(_VB)
def vb_nmf_sweep_u(spark, sf_dir):
    x, own, other, u, v, _ = _sweep(spark, sf_dir, "i", K.variational)

    def flat(block, *shared):
        return K.variational(block, *shared)[:, :, [3, 2, 0]].reshape(len(block.ids), -1)

    out = x.frame(flat, own, other, v / 4, np.full(own.shape, 0.1), 0.5)
    names = [f"{c}{k}" for k in (0, 1) for c in ("prec", "mu", "mean")]
    return out.select(F.col("idx").alias("i"), *(F.round(F.element_at("vec", c + 1), {"pr": 6, "mu": 5}.get(n[:2], 4)).alias(n) for c, n in enumerate(names)))


@query("SELECT CAST(id % 20 AS BIGINT) AS idx, round(avg(CAST((id // 20) * (id // 20) AS DOUBLE) * (id % 20 + 1)), 6) AS mean FROM range(0, 4000) t(id) WHERE id // 20 >= 20 AND (id // 20 - 20) % 3 = 0 GROUP BY 1")
def gibbs_thinned_mean(spark, sf_dir):
    samples = {name: [float(it * it) * np.arange(1, 21)[:, None] for it in range(200)] for name in ("u", "v")} | {"tau": [1.0] * 200}
    fit = Fit(1, None, samples["u"][-1], samples["v"][-1], None, 1.0, 0.0, 0, samples=samples)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(fit.factors(20, 3)[0][:, 0])], "idx long, mean double")


# --- K-means -----------------------------------------------------------------------------------------------------------------

_CENTRE = "(20 + 3 * c + (j * 3 + c) % 7)"
_NEAR = f"d AS (SELECT i, c, avg((r - {_CENTRE}) ** 2) AS d FROM obs, range(0, 4) t(c) GROUP BY i, c), near AS (SELECT i, arg_min(c, d * 1000 + c * 1e-9) AS cluster FROM d GROUP BY i)"


def _centres(n: int) -> np.ndarray:
    c, j = np.meshgrid(np.arange(4), np.arange(n), indexing="ij")
    return 20.0 + 3 * c + (j * 3 + c) % 7


def _assigned(spark, sf_dir):
    x, _, n_j = side(spark, sf_dir, "i")

    return x.frame(nearest, _centres(n_j), np.ones((4, n_j))).select(F.col("idx").alias("i"), F.element_at("vec", 1).cast("bigint").alias("cluster"))


@query(f"{obs_sql()}, {_NEAR} SELECT i, CAST(cluster AS BIGINT) AS cluster FROM near")
def kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query(f"{obs_sql()}, {_NEAR} SELECT CAST(cluster AS BIGINT) AS cluster, j, round(avg(r), 6) AS centre, count(*) AS cells FROM obs JOIN near USING (i) GROUP BY 1, 2")
def kmeans_update(spark, sf_dir):
    return centres_of(observed(spark, sf_dir)[0], _assigned(spark, sf_dir)).select("cluster", "j", r6("centre").alias("centre"), "cells")


# --- selection, averages -------------------------------------------------------------------------------------------------------

_TRIALS = "SELECT CAST(1 + id % 6 AS INTEGER) AS \"K\", CAST(1 + (id // 6) % 5 AS INTEGER) AS \"L\", CAST(id // 30 AS INTEGER) AS fold, CAST((id * 37) % 101 AS DOUBLE) / 10 + abs(1 + id % 6 - 4) AS value FROM range(0, 300) t(id)"


def _trials(spark):
    return spark.range(300).selectExpr("cast(1 + id % 6 as int) as K", "cast(1 + (id div 6) % 5 as int) as L", "cast(id div 30 as int) as fold", "cast((id * 37) % 101 as double) / 10 + abs(1 + id % 6 - 4) as value")


def _searched(means) -> Search:
    """A search that has found these values."""
    search = Search(Setup("icm"))
    search.results = {(r.K, r["L"] if "L" in r else None): {"AIC": r.v} for r in sorted(means.collect(), key=lambda r: tuple(r)[:-1])}
    return search


@query(f'WITH t AS ({_TRIALS}), m AS (SELECT "K", avg(value) AS v FROM t GROUP BY 1) SELECT "K", round(v, 6) AS value FROM m ORDER BY v, "K" LIMIT 1')
def best_k(spark, sf_dir):
    search = _searched(_trials(spark).groupBy("K").agg(F.avg("value").alias("v")))
    k = search.best_value("AIC")
    return spark.createDataFrame([(k, round(search.results[k, None]["AIC"], 6))], "K int, value double")


@query(f'WITH t AS ({_TRIALS}), m AS (SELECT "K", "L", avg(value) AS v FROM t GROUP BY 1, 2) SELECT "K", "L", round(v, 6) AS value FROM m ORDER BY v, "K", "L" LIMIT 1')
def best_kl(spark, sf_dir):
    search = _searched(_trials(spark).groupBy("K", "L").agg(F.avg("value").alias("v")))
    k, l = search.best_value("AIC")
    return spark.createDataFrame([(k, l, round(search.results[k, l]["AIC"], 6))], "K int, L int, value double")


@query(f'SELECT "K", "L", round(avg(value), 6) AS value, count(*) AS folds FROM ({_TRIALS}) GROUP BY 1, 2')
def cv_average(spark, sf_dir):
    rows = [{"K": r.K, "L": r.L, "test": {"MSE": r.value, "R^2": 0.0, "Rp": 0.0}} for r in _trials(spark).collect()]
    sizes = sorted({(r["K"], r["L"]) for r in rows})
    found = averaged(rows, [{"K": k, "L": l} for k, l in sizes])
    return spark.createDataFrame([(k, l, round(v["MSE"], 6), len(v["folds"])) for (k, l), v in zip(sizes, found.values())], "K int, L int, value double, folds long")


@query(f'SELECT "K", round(median(value), 6) AS value FROM ({_TRIALS}) GROUP BY 1')
def sweep_median(spark, sf_dir):
    return summary(_trials(spark), "K").select("K", r6("median").alias("value"))


# --- fits of one factor from a fixed beginning --------------------------------------------------------------------------------


def _rank1_sql(u: str, v: str, tau: str | None, iterations: int, start: float) -> str:
    """Iterations of one factor in SQL; u and v: its updates from the sums of rows' or columns' cells."""
    steps, now = [], "b0"
    steps.append(f"b0 AS (SELECT i, j, r, CAST({start} AS DOUBLE) AS u, CAST({start} AS DOUBLE) AS v FROM obs)")
    errors = "count(*) AS n, sum((r - u * v) ** 2) AS se"
    steps.append(f"e0 AS (SELECT {errors} FROM b0)")
    for it in range(1, iterations + 1):
        t = f"(SELECT {tau} FROM e{it - 1})" if tau else "1"
        steps.append(f"u{it} AS (SELECT i, {u.format(t=t)} AS nu FROM {now} GROUP BY i)")
        steps.append(f"c{it} AS (SELECT i, j, r, nu AS u, v FROM {now} JOIN u{it} USING (i))")
        steps.append(f"v{it} AS (SELECT j, {v.format(t=t)} AS nv FROM c{it} GROUP BY j)")
        steps.append(f"b{it} AS (SELECT i, j, r, u, nv AS v FROM c{it} JOIN v{it} USING (j))")
        steps.append(f"e{it} AS (SELECT {errors} FROM b{it})")
        now = f"b{it}"
    out = " UNION ALL ".join(f"SELECT {it - 1} AS iteration, round(se / n, 5) AS mse FROM e{it}" for it in range(1, iterations + 1))
    return f"{obs_sql()}, {', '.join(steps)} {out}"


def _rank1(method: str, start: str):
    def run(spark, sf_dir):
        rows, columns = spark_sides(*observed(spark, sf_dir))
        try:
            fit = Factorizer(method, 1, None, Priors(), start).fit(rows, columns, 3)
        finally:
            rows.close()
            columns.close()
        return spark.createDataFrame([(h["iteration"], round(float(h["MSE"]), 5)) for h in fit.history], "iteration int, mse double")

    return run


@query(_rank1_sql("any_value(u) * sum(v * r / (u * v)) / sum(v)", "any_value(v) * sum(u * r / (u * v)) / sum(u)", None, 3, 1.0))
def np_nmf_one_factor(spark, sf_dir):
    return _rank1("np", "ones")(spark, sf_dir)


@query(_rank1_sql("greatest(0, ({t} * sum(r * v) - 0.1) / ({t} * sum(v * v)))", "greatest(0, ({t} * sum(r * u) - 0.1) / ({t} * sum(u * u)))", "(n / 2.0) / (1 + se / 2)", 3, 10.0))
def icm_nmf_one_factor(spark, sf_dir):
    return _rank1("icm", "exp")(spark, sf_dir)


# --- fits: rows only -----------------------------------------------------------------------------------------------------------


def _fit_query(method: str, tri: bool, iterations: int):
    def run(spark, sf_dir):
        """History of a fit on executors: rows stay packed, factors are broadcast once a half-sweep. The variational factors have
        four planes and stay on the executors, as tables of blocks."""
        obs, n_i, n_j = observed(spark, sf_dir)
        settings = dict(method=method, k=3, l=2 if tri else None, priors=Priors(), init="random", seed=SEED)
        if method == "vb":
            fit = BlockedFactorizer(**settings).fit_table(obs, n_i, n_j, iterations)
        else:
            rows, columns = spark_sides(obs, n_i, n_j)
            try:
                fit = Factorizer(**settings).fit(rows, columns, iterations)
            finally:
                rows.close()
                columns.close()
        out = [(h["iteration"], float(h["MSE"]), float(h["R^2"]), float(h["Rp"])) for h in fit.history]
        return spark.createDataFrame(out, "iteration int, mse double, r2 double, rp double")

    run.__name__ = f"{method}_{'nmtf' if tri else 'nmf'}_fit"
    return query()(run)


for _m in ("np", "icm", "gibbs", "vb"):
    for _t in (False, True):
        _fit_query(_m, _t, 2 if (_m, _t) == ("np", True) else 3)


def _small(spark, sf_dir) -> Cells:
    return Cells.from_df(*observed(spark, sf_dir, "sb"))


@query()
def line_search(spark, sf_dir):
    return LineSearch(Setup("vb", iterations=20, init="random", seed=SEED, restarts=2), [1, 2, 3]).search(spark, _small(spark, sf_dir)).frame(spark)


@query()
def grid_search(spark, sf_dir):
    return GridSearch(Setup("icm", iterations=20, init="random", seed=SEED), [1, 2], [1, 2]).search(spark, _small(spark, sf_dir)).frame(spark)


@query()
def greedy_search(spark, sf_dir):
    return GreedySearch(Setup("vb", iterations=20, init="random", seed=SEED), [1, 2, 3], [1, 2, 3]).search(spark, _small(spark, sf_dir), "AIC").frame(spark)


@query()
def line_search_cross_validation(spark, sf_dir):
    return line_search_cv(spark, _small(spark, sf_dir), Setup("vb", iterations=15, init="random", seed=SEED), [1, 2], 3).frame(spark)


@query()
def matrix_cross_validation(spark, sf_dir):
    found = matrix_cv(spark, _small(spark, sf_dir), Setup("np", iterations=20, init="random", seed=SEED), [{"K": 1}, {"K": 2}], 3)
    return spark.createDataFrame([(k, v["MSE"], v["R^2"], v["Rp"]) for k, v in found.items()], "params string, mse double, r2 double, rp double")


@query()
def nested_cross_validation(spark, sf_dir):
    return nested_cv(spark, _small(spark, sf_dir), Setup("np", iterations=15, init="random", seed=SEED), [{"K": 1}, {"K": 2}], 3).frame(spark)


@query()
def kmeans_fit(spark, sf_dir):
    """On executors: a cluster for each row of the larger matrix."""
    from ..operators.kmeans import MaskedKMeans

    sides = spark_sides(*observed(spark, sf_dir))
    try:
        found = MaskedKMeans(4, SEED).fit_table(*sides)
        return written(found.select(F.col("idx").alias("i"), F.col("cluster").cast("bigint").alias("cluster")))
    finally:
        for s in sides:
            s.close()


@query()
def generate_nmf_toy(spark, sf_dir):
    return generate_nmf(spark, 100, 80, 10, seed=SEED)[2]


@query()
def generate_nmtf_toy(spark, sf_dir):
    return generate_nmtf(spark, 100, 80, 5, 5, seed=SEED)[3]


@query()
def missing_fraction_sweep(spark, sf_dir):
    return missing_sweep(spark, Setup("icm", Priors(rows=1.0, columns=1.0), "random", iterations=50, seed=SEED), 10, None, [0.1, 0.3, 0.5, 0.7, 0.9])


@query()
def noise_ratio_sweep(spark, sf_dir):
    return noise_sweep(spark, Setup("icm", Priors(rows=1.0, columns=1.0), "random", iterations=50, seed=SEED), 10, None, [0.0, 0.1, 0.5])


@query()
def convergence_history(spark, sf_dir):
    cells = _small(spark, sf_dir)
    return convergence(spark, Setup("vb", init="random", seed=SEED).model(3, None, SEED).fit(*cells.sides(), 30, cells)).drop("elapsed")


@query()
def timing_by_iteration(spark, sf_dir):
    return timing(spark, Setup("icm", init="random", seed=SEED, iterations=10), _small(spark, sf_dir), 3, None, 4)


@query()
def greedy_search_cross_validation(spark, sf_dir):
    return greedy_search_cv(spark, _small(spark, sf_dir), Setup("vb", iterations=15, init="random", seed=SEED), [1, 2], [1, 2], 3).frame(spark)


@query()
def kernelized_nested_cross_validation(spark, sf_dir):
    from ..operators.kernelized import FilledLikeness, KernelSetup, nested_cross_validate

    c = _small(spark, sf_dir)
    return nested_cross_validate(spark, FilledLikeness(False), FilledLikeness(True), c, KernelSetup(iterations=3), [1, 2], 2).frame(spark)


@query()
def kernelized_cross_validation(spark, sf_dir):
    """Latent sizes compared by folds."""
    from ..operators.kernelized import FilledLikeness, KernelSetup, cross_validate

    c = _small(spark, sf_dir)
    found, _ = cross_validate(spark, FilledLikeness(False), FilledLikeness(True), c, KernelSetup(iterations=5), [1, 2], 2)
    return spark.createDataFrame([(k, v["MSE"], v["R^2"], v["Rp"]) for k, v in found.items()], "params string, mse double, r2 double, rp double")


# The rest of the queries stand in modules of their own, which use this one.
from . import draws, files, fits, scaled, splits  # noqa: E402, F401
