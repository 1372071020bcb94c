"""Fits on executors that no broadcast or single process bounds: factors in blocks, folds and sizes side by side, errors on
test cells in each iteration. From fixed beginnings, so that SQL gives the same numbers."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..operators.batched import FoldedMatrix
from ..operators.blocked import BlockedFactorizer
from ..operators.kmeans import MaskedKMeans
from ..operators.masks import covering_folds
from ..operators.models import Factorizer, Priors, spark_sides
from ..operators.tables import deleted, written
from ..operators.trials import GreedySearch, Setup, _trial, line_search_cv, matrix_cv
from .fits import RATE, FitSQL, _cells, _found
from .registry import SEED, query
from .relations import obs_sql, observed

PRIORS = Priors(rows=RATE, columns=RATE, middle=RATE)


def _begin(method: str) -> float:
    return 1.0 if method == "np" else 1 / RATE


# --- factors in blocks -----------------------------------------------------------------------------------------------------


def _blocked(method: str, l: int | None, rows: int = 256) -> None:
    sql = FitSQL(method, 2, l, _begin(method), joint=method == "np").run(2)

    def run(spark, sf_dir):
        """Errors after each iteration of a fit whose factors are tables of blocks."""
        fit = BlockedFactorizer(method, 2, l, PRIORS).fit_table(*observed(spark, sf_dir), 2, rows=rows)
        out = [(h["iteration"], round(float(h["MSE"]), 5), round(float(h["R^2"]), 6), round(float(h["Rp"]), 6)) for h in fit.history]
        return spark.createDataFrame(out, "iteration int, mse double, r2 double, rp double")

    run.__name__ = f"{method}_{'nmtf' if l else 'nmf'}_blocked"
    query(f"{obs_sql()}, {', '.join(sql.tables)} {sql.history()}")(run)


for _m in ("np", "icm"):
    _blocked(_m, None)
    _blocked(_m, 2)


_sweep = FitSQL("icm", 2, None, _begin("icm")).run(1)


@query(f"{obs_sql()}, {', '.join(_sweep.tables)} SELECT DISTINCT i, round(u0, 5) AS f0, round(u1, 5) AS f1 FROM {_sweep.now}")
def icm_blocked_factor(spark, sf_dir):
    """The factor of the rows after an iteration, as a table."""
    u = BlockedFactorizer("icm", 2, None, PRIORS).fit_table(*observed(spark, sf_dir), 1, rows=512).u
    return u.select(F.col("idx").alias("i"), *(F.round(F.element_at("vec", c + 1), 5).alias(f"f{c}") for c in (0, 1)))


@query(f"{obs_sql()}, {', '.join(_sweep.tables)} SELECT i, j, round({_sweep.p}, 5) AS p FROM {_sweep.now}")
def icm_blocked_predictions(spark, sf_dir):
    obs, n_i, n_j = observed(spark, sf_dir)
    fit = BlockedFactorizer("icm", 2, None, PRIORS).fit_table(obs, n_i, n_j, 1, rows=512)
    return fit.predicted(obs.select("i", "j")).select("i", "j", F.round("p", 5).alias("p"))


# --- folds and sizes side by side ------------------------------------------------------------------------------------------

FOLDS = 2
_KEY = f"md5('{SEED}|' || CAST(i AS VARCHAR) || '|' || CAST(j AS VARCHAR))"
#: obs with covering folds.
_FOLDED = f"""{obs_sql()}, keyed AS (SELECT i, j, r, {_KEY} AS k FROM obs),
cover AS (SELECT i, arg_min(j, k) AS j FROM keyed GROUP BY i UNION SELECT arg_min(i, k), j FROM keyed GROUP BY j),
rest AS (SELECT i, j, r, row_number() OVER (ORDER BY k, i, j) - 1 AS p FROM keyed ANTI JOIN cover USING (i, j)),
folded AS MATERIALIZED (SELECT i, j, r, ((p + 1) * {FOLDS} - 1) // (SELECT count(*) FROM rest) AS fold FROM rest UNION ALL SELECT i, j, r, -1 FROM obs SEMI JOIN cover USING (i, j))"""


def _cv_sql(method: str, sizes: list[tuple[int, int | None]], iterations: int) -> tuple[str, str]:
    """Tables, and a relation of K, L, fold, aic, mse, test_mse and test_rp."""
    tables, rows = [], []
    for no, (k, l) in enumerate(sizes):
        for f in range(FOLDS):
            fit = FitSQL(method, k, l, _begin(method), f"f{no}_{f}_", f"(SELECT *, fold <> {f} AS train FROM folded)").run(iterations)
            tables += [*fit.tables, f"q{no}_{f} AS MATERIALIZED ({fit.quality()})"]
            rows.append(f'SELECT CAST({k} AS INTEGER) AS "K", CAST({l or "NULL"} AS INTEGER) AS "L", {f} AS fold, 2 * k - 2 * ll AS aic, mse, t.se / t.n AS test_mse, t.rp / sqrt(t.rr * t.pp) AS test_rp FROM q{no}_{f}, {fit.tests[-1]} t')
    return ", ".join(tables), " UNION ALL ".join(rows)


def _matrix(spark, sf_dir) -> FoldedMatrix:
    return FoldedMatrix.of(*observed(spark, sf_dir), FOLDS, SEED)


_np = _cv_sql("np", [(1, None), (2, None)], 2)
_icm = _cv_sql("icm", [(1, 1), (2, 2)], 2)


def _side_by_side(name: str, method: str, sizes: list[tuple[int, int | None]], made: tuple[str, str]) -> None:
    @query(f'{_FOLDED}, {made[0]} SELECT "K", "L", CAST(fold AS INTEGER) AS fold, round(aic, 2) AS aic, round(mse, 5) AS mse, round(test_mse, 5) AS test_mse, round(test_rp, 5) AS test_rp FROM ({made[1]})')
    def run(spark, sf_dir):
        """Quality on the training part and errors on the fold, of all sizes and folds in the same passes."""
        setup = Setup(method, PRIORS, iterations=2)
        matrix = _matrix(spark, sf_dir)
        try:
            rows = matrix.run(setup, [_trial(setup, k, l, 0, fold=f) for k, l in sizes for f in range(FOLDS)])
        finally:
            matrix.close()
        out = [(r["K"], r["L"], r["fold"], *(round(float(x), d) for x, d in ((r["AIC"], 2), (r["MSE"], 5), (r["test"]["MSE"], 5), (r["test"]["Rp"], 5)))) for r in rows]
        return spark.createDataFrame(out, "K int, L int, fold int, aic double, mse double, test_mse double, test_rp double")

    from . import registry

    for table in (registry._QUERIES, registry._SQL):
        table[name] = table.pop("run")


_side_by_side("np_nmf_folds", "np", [(1, None), (2, None)], _np)
_side_by_side("icm_nmtf_folds", "icm", [(1, 1), (2, 2)], _icm)


@query(f'{_FOLDED}, {_np[0]} SELECT "K", round(avg(test_mse), 5) AS mse, round(avg(test_rp), 5) AS rp FROM ({_np[1]}) GROUP BY "K"')
def matrix_cv_executors(spark, sf_dir):
    """Mean errors of each parameter set over folds, on executors."""
    matrix = _matrix(spark, sf_dir)
    try:
        found = matrix_cv(spark, matrix, Setup("np", PRIORS, iterations=2), [{"K": 1}, {"K": 2}], FOLDS)
    finally:
        matrix.close()
    return spark.createDataFrame([(json.loads(p)["K"], round(float(v["MSE"]), 5), round(float(v["Rp"]), 5)) for p, v in found.items()], "K int, mse double, rp double")


@query(f'{_FOLDED}, {_np[0]}, found AS MATERIALIZED ({_np[1]}), best AS (SELECT fold, arg_min("K", aic) AS "K" FROM found GROUP BY fold) SELECT CAST(fold AS INTEGER) AS fold, "K", round(test_mse, 5) AS mse FROM best JOIN found USING (fold, "K")')
def line_search_cv_executors(spark, sf_dir):
    """For each fold the size that is best on its training part, refitted and judged on the fold."""
    matrix = _matrix(spark, sf_dir)
    try:
        found = line_search_cv(spark, matrix, Setup("np", PRIORS, iterations=2), [1, 2], FOLDS)
    finally:
        matrix.close()
    return spark.createDataFrame([(f, k, round(float(p["MSE"]), 5)) for (f, (k, _)), p in zip(found.chosen.items(), found.performances)], "fold int, K int, mse double")


def _tested(method: str) -> None:
    sql = FitSQL(method, 2, None, _begin(method), source="(SELECT *, fold <> 0 AS train FROM folded)").run(2)
    out = " UNION ALL ".join(f"SELECT {n} AS iteration, round(e.se / e.n, 5) AS mse, round(t.se / t.n, 5) AS test_mse, round(1 - t.se / t.rr, 6) AS test_r2, round(t.rp / sqrt(t.rr * t.pp), 6) AS test_rp FROM {e} e, {t} t" for n, (e, t) in enumerate(zip(sql.errors[1:], sql.tests[1:])))

    def run(spark, sf_dir):
        """Errors on the training cells and on a fold after each iteration, from the same pass."""
        obs, n_i, n_j = observed(spark, sf_dir)
        folded = covering_folds(obs, FOLDS, SEED)
        far = spark_sides(folded, n_i, n_j, fold=0)
        try:
            fit = Factorizer(method, 2, None, PRIORS).fit(*far, 2)
        finally:
            for s in far:
                s.close()
            deleted(folded)
        rows = [(h["iteration"], round(float(h["MSE"]), 5), round(float(h["test_MSE"]), 5), round(float(h["test_R^2"]), 6), round(float(h["test_Rp"]), 6)) for h in fit.history]
        return spark.createDataFrame(rows, "iteration int, mse double, test_mse double, test_r2 double, test_rp double")

    run.__name__ = f"{method}_nmf_tested_history"
    query(f"{_FOLDED}, {', '.join(sql.tables)} {out}")(run)


_tested("np")
_tested("icm")


# --- a greedy walk in both sizes ---------------------------------------------------------------------------------------------

_K, _L = [1, 2, 3], [1, 2]


def _walk_sql(iterations: int) -> str:
    """All sizes are fitted; the walk goes through them, and only sizes that it looks at are given."""
    tables, rows = [], []
    for a, k in enumerate(_K):
        for b, l in enumerate(_L):
            fit = FitSQL("icm", k, l, _begin("icm"), f"f{a}{b}_").run(iterations)
            tables += [*fit.tables, f"q{a}{b} AS MATERIALIZED ({fit.quality()})"]
            rows.append(f'SELECT {a} AS a, {b} AS b, CAST({k} AS INTEGER) AS "K", CAST({l} AS INTEGER) AS "L", ll, 2 * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic, mse FROM q{a}{b}')
    values = " UNION ALL ".join(f"SELECT \"K\", \"L\", '{m}' AS metric, round({x}, 3) AS value, aic = (SELECT min(aic) FROM found) AS best FROM found" for m, x in (("loglikelihood", "ll"), ("BIC", "bic"), ("AIC", "aic"), ("MSE", "mse"), ("ELBO", "CAST(0 AS DOUBLE)")))
    return f"""{obs_sql('sb').replace('WITH cells', 'WITH RECURSIVE cells', 1)}, {', '.join(tables)}, grid AS MATERIALIZED ({' UNION ALL '.join(rows)}),
steps AS MATERIALIZED (SELECT h.a, h.b, n.a AS na, n.b AS nb, h.aic AS here, n.aic AS there FROM grid h JOIN grid n ON (n.a - h.a, n.b - h.b) IN ((1, 0), (0, 1), (1, 1))),
best AS MATERIALIZED (SELECT a, b, arg_min(na, there) AS na, arg_min(nb, there) AS nb, any_value(here) AS here, min(there) AS there FROM steps GROUP BY a, b),
walk(a, b) AS (SELECT 0, 0 UNION ALL SELECT best.na, best.nb FROM walk JOIN best USING (a, b) WHERE there <= here),
found AS MATERIALIZED (SELECT DISTINCT grid.* FROM grid JOIN (SELECT a, b FROM walk UNION SELECT na, nb FROM walk JOIN steps USING (a, b)) USING (a, b)) {values}"""


@query(_walk_sql(2))
def greedy_search_walk(spark, sf_dir):
    """Steps in K, in L and in both."""
    return _found(spark, GreedySearch(Setup("icm", iterations=2), _K, _L).search(spark, _cells(spark, sf_dir), "AIC"))


# --- K-means from fixed centres ----------------------------------------------------------------------------------------------

#: Three centres; the last is far from all points, so that it is empty and takes the furthest point.
_AT = "CASE c WHEN 0 THEN 20 + j % 3 WHEN 1 THEN 30 - j % 4 ELSE 900 END"


def _clusters_sql(passes: int) -> str:
    tables = [f"c0 AS (SELECT c, j, CAST({_AT} AS DOUBLE) AS x FROM range(0, 3) t(c), (SELECT DISTINCT j FROM obs))"]
    for n in range(passes + 1):
        # A centre that shares no coordinate with a point is not near it; a point near none goes to the last.
        tables.append(f"d{n} AS (SELECT i, c, avg((r - x) ** 2) AS d FROM obs JOIN c{n} USING (j) GROUP BY i, c)")
        tables.append(f"a{n} AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY i)")
        # The furthest points, as many as there are empty clusters, go to these.
        tables.append(f"e{n} AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM range(0, 3) t(c) WHERE c NOT IN (SELECT c FROM a{n}))")
        tables.append(f"m{n} AS MATERIALIZED (SELECT a.i, coalesce(e.c, a.c) AS c FROM (SELECT *, row_number() OVER (ORDER BY d DESC, i) AS k FROM a{n}) a LEFT JOIN e{n} e USING (k))")
        tables.append(f"c{n + 1} AS MATERIALIZED (SELECT c, j, avg(r) AS x FROM obs JOIN m{n} USING (i) GROUP BY c, j)")
    return f"{obs_sql()}, {', '.join(tables)} SELECT i, CAST(c AS INTEGER) AS cluster FROM a{passes}"


@query(_clusters_sql(2))
def kmeans_whole_fit(spark, sf_dir):
    """Clusters after two passes from fixed centres, one of which is empty at first."""
    obs, n_i, n_j = observed(spark, sf_dir)
    j = np.arange(n_j)
    far = spark_sides(obs, n_i, n_j)
    try:
        found = MaskedKMeans(3, SEED, passes=2).fit_table(*far, np.stack((20 + j % 3, 30 - j % 4, np.full(n_j, 900))))
        return written(found.select(F.col("idx").alias("i"), "cluster"))
    finally:
        for s in far:
            s.close()
