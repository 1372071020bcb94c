"""Whole fits and searches from fixed beginnings, and their SQL: no draw is involved, so both sides give equal numbers."""

from __future__ import annotations


from ..operators.models import Cells, Factorizer, Priors, spark_sides
from ..operators.trials import GreedySearch, GridSearch, LineSearch, Setup
from .registry import query
from .relations import obs_sql, observed

RATE = 0.1


class FitSQL:
    """Common table expressions of a fit of k (and l) factors: after each step the cells with all factors beside them.

    source: a relation of i, j, r and train; cells for which train does not hold are tested. joint: the middle factor's
    values change all at once."""

    def __init__(self, method: str, k: int, l: int | None, start: float, name: str = "f", source: str = "(SELECT *, true AS train FROM obs)", joint: bool = False):
        self.method, self.name, self.tables, self.errors, self.tests, self.joint = method, name, [], [], [], joint
        self.u, self.v = [f"u{a}" for a in range(k)], [f"v{b}" for b in range(l or k)]
        self.s = [[f"s{a}{b}" for b in range(l)] for a in range(k)] if l else None
        middle = [x for row in self.s or [] for x in row]
        self._table(f"SELECT i, j, r, train, {', '.join(f'CAST({start} AS DOUBLE) AS {x}' for x in self.u + self.v + middle)} FROM {source}")
        through = lambda a: "(" + " + ".join(f"{self.s[a][b]} * {y}" for b, y in enumerate(self.v)) + ")" if self.s else self.v[a]
        across = lambda b: "(" + " + ".join(f"{x} * {self.s[a][b]}" for a, x in enumerate(self.u)) + ")" if self.s else self.u[b]
        self.steps = {
            "u": [(x, through(a), "i") for a, x in enumerate(self.u)],
            "s": [(self.s[a][b], f"{x} * {y}", None) for a, x in enumerate(self.u) for b, y in enumerate(self.v)] if self.s else [],
            "v": [(y, across(b), "j") for b, y in enumerate(self.v)],
        }
        self.p = "(" + " + ".join(f"{x} * {through(a)}" for a, x in enumerate(self.u)) + ")"

    def _table(self, sql: str) -> str:
        self.now = f"{self.name}{len(self.tables)}"
        self.tables.append(f"{self.now} AS MATERIALIZED ({sql})")
        return self.now

    def _error(self) -> None:
        at = self.now
        for errors, where in ((self.errors, "WHERE train"), (self.tests, "WHERE NOT train")):
            mean = f"(SELECT avg({{}}) FROM {at} {where})"
            dr, dp = f"(r - {mean.format('r')})", f"({self.p} - {mean.format(self.p)})"
            errors.append(self._table(f"SELECT count(*) AS n, sum((r - {self.p}) ** 2) AS se, sum({dr} * {dr}) AS rr, sum({dp} * {dp}) AS pp, sum({dr} * {dp}) AS rp FROM {at} {where}"))
        self.now = at

    def _tau(self) -> str:
        return f"(SELECT n / 2.0 / (1 + se / 2) FROM {self.errors[-1]})"

    def _step(self, x: str, h: str, by: str | None) -> None:
        at = self.now
        if self.method == "np":
            new = f"any_value({x}) * sum({h} * r / {self.p}) / sum({h})"
        else:
            new = f"CASE WHEN sum({h} * {h}) > 0 THEN greatest(0, ({self._tau()} * sum({h} * (r - {self.p} + {x} * {h})) - {RATE}) / ({self._tau()} * sum({h} * {h}))) ELSE any_value({x}) END"
        found = self._table(f"SELECT {by + ', ' if by else ''}{new} AS x FROM {at} WHERE train{' GROUP BY ' + by if by else ''}")
        if by:
            self._table(f"SELECT {at}.* EXCLUDE ({x}), {found}.x AS {x} FROM {at} JOIN {found} USING ({by})")
        else:
            self._table(f"SELECT * EXCLUDE ({x}), (SELECT x FROM {found}) AS {x} FROM {at}")

    def _all_at_once(self) -> None:
        at, names = self.now, [x for x, _, _ in self.steps["s"]]
        found = self._table("SELECT " + ", ".join(f"any_value({x}) * sum({h} * r / {self.p}) / sum({h}) AS {x}" for x, h, _ in self.steps["s"]) + f" FROM {at} WHERE train")
        self._table(f"SELECT c.* EXCLUDE ({', '.join(names)}), {', '.join(f'f.{x}' for x in names)} FROM {at} c, {found} f")

    def run(self, iterations: int) -> FitSQL:
        self._error()
        for _ in range(iterations):
            for part in ("s", "u", "v") if self.method == "np" else ("u", "s", "v"):
                if part == "s" and self.s and self.joint:
                    self._all_at_once()
                    continue
                for step in self.steps[part]:
                    self._step(*step)
            self._error()
        return self

    def history(self) -> str:
        return " UNION ALL ".join(f"SELECT {n} AS iteration, round(se / n, 5) AS mse, round(1 - se / rr, 6) AS r2, round(rp / sqrt(rr * pp), 6) AS rp FROM {e}" for n, e in enumerate(self.errors[1:]))

    def quality(self) -> str:
        """One row: n, the log-likelihood ll, the number of parameters k and the MSE."""
        tau = "1.0" if self.method == "np" else self._tau()
        size = f"n_i * {len(self.u)} + n_j * {len(self.v)} + {len(self.u) * len(self.v) if self.s else 0}"
        return f"SELECT n, n / 2.0 * (ln({tau}) - ln(2 * pi())) - {tau} / 2 * se AS ll, (SELECT {size} FROM meta) AS k, se / n AS mse FROM {self.errors[-1]}"


def _history(method: str, k: int, l: int | None, iterations: int) -> None:
    sql = FitSQL(method, k, l, 1.0 if method == "np" else 1 / RATE).run(iterations)

    def run(spark, sf_dir):
        """Errors after each iteration of a fit on executors."""
        sides = spark_sides(*observed(spark, sf_dir))
        try:
            fit = Factorizer(method, k, l, Priors(rows=RATE, columns=RATE, middle=RATE)).fit(*sides, iterations)
        finally:
            for s in sides:
                s.close()
        out = [(h["iteration"], round(float(h["MSE"]), 5), round(float(h["R^2"]), 6), round(float(h["Rp"]), 6)) for h in fit.history]
        return spark.createDataFrame(out, "iteration int, mse double, r2 double, rp double")

    run.__name__ = f"{method}_{'nmtf' if l else 'nmf'}_history"
    query(f"{obs_sql()}, {', '.join(sql.tables)} {sql.history()}")(run)


for _m in ("np", "icm"):
    _history(_m, 2, None, 2)
    _history(_m, 2, 2, 2)


# --- searches ------------------------------------------------------------------------------------------------------------------


def _search_sql(method: str, sizes: list[tuple[int, int | None]], iterations: int, greedy: bool = False) -> str:
    tables, rows = [], []
    for no, (k, l) in enumerate(sizes):
        fit = FitSQL(method, k, l, 1.0 if method == "np" else 1 / RATE, f"f{no}_").run(iterations)
        tables += [*fit.tables, f"q{no} AS MATERIALIZED (SELECT *, 2 * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic FROM ({fit.quality()}))"]
        # A greedy walk along K goes on while the next size is no worse.
        reached = "".join(f" AND (SELECT aic FROM q{a + 1}) <= (SELECT aic FROM q{a})" for a in range(no - 1)) if greedy else ""
        rows.append(f'SELECT CAST({k} AS INTEGER) AS "K", CAST({l or "NULL"} AS INTEGER) AS "L", ll, aic, bic, mse FROM q{no} WHERE true{reached}')
    long = " UNION ALL ".join(f"SELECT \"K\", \"L\", '{m}' AS metric, round({x}, 3) AS value, aic = (SELECT min(aic) FROM found) AS best FROM found" for m, x in (("loglikelihood", "ll"), ("BIC", "bic"), ("AIC", "aic"), ("MSE", "mse"), ("ELBO", "CAST(0 AS DOUBLE)")))
    return f"{obs_sql('sb')}, {', '.join(tables)}, found AS MATERIALIZED ({' UNION ALL '.join(rows)}) {long}"


def _found(spark, search):
    """All values of a search, and whether their size is the best one by AIC."""
    best = search.best_value("AIC")
    rows = [(k, l, m, round(float(x), 3), (k if l is None else (k, l)) == best) for m in ("loglikelihood", "BIC", "AIC", "MSE", "ELBO") for k, l, x in search.all_values(m)]
    return spark.createDataFrame(rows, "K int, L int, metric string, value double, best boolean")


def _cells(spark, sf_dir) -> Cells:
    return Cells.from_df(*observed(spark, sf_dir, "sb"))


@query(_search_sql("np", [(1, None), (2, None), (3, None)], 2))
def line_search_values(spark, sf_dir):
    return _found(spark, LineSearch(Setup("np", iterations=2, restarts=2), [1, 2, 3]).search(spark, _cells(spark, sf_dir)))


@query(_search_sql("icm", [(1, 1), (1, 2), (2, 1), (2, 2)], 2))
def grid_search_values(spark, sf_dir):
    return _found(spark, GridSearch(Setup("icm", iterations=2), [1, 2], [1, 2]).search(spark, _cells(spark, sf_dir)))


@query(_search_sql("icm", [(1, 1), (2, 1), (3, 1)], 2, greedy=True))
def greedy_search_values(spark, sf_dir):
    """A walk along K that ends where the next size is worse."""
    return _found(spark, GreedySearch(Setup("icm", iterations=2), [1, 2, 3], [1]).search(spark, _cells(spark, sf_dir), "AIC"))


# --- variational fits of one factor ----------------------------------------------------------------------------------------------


def _mills(x: str, depth: int = 40) -> str:
    """The standard normal's density over its upper tail at x, by the continued fraction x + 1/(x + 2/(x + ...))."""
    out = x
    for n in range(depth, 0, -1):
        out = f"({x} + {n} / {out})"
    return out


def _moments(source: str) -> str:
    """mean, var and the logarithm of the mass above 0 of N(mu, 1 / prec) cut at 0, beside the columns of source.

    The mass is that of the lower tail at z, by the series of erf in the middle and the continued fraction beyond 2."""
    density = "exp(-z * z / 2) / sqrt(2 * pi())"
    series = "list_sum(list_transform(range(0, 60), lambda m: CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * exp((2 * m + 1) * ln(abs(z) / sqrt(2) + 1e-300) - lgamma(m + 1)) / (2 * m + 1)))"
    mass = f"CASE WHEN z < -2 THEN {density} / {_mills('(-z)')} WHEN z > 2 THEN 1 - {density} / {_mills('z')} ELSE 0.5 + sign(z) / sqrt(pi()) * {series} END"
    hazard = f"SELECT *, {density} / mass AS h FROM (SELECT *, {mass} AS mass FROM (SELECT *, mu * sqrt(prec) AS z FROM ({source})))"
    return f"SELECT * EXCLUDE (z, mass, h), mu + h / sqrt(prec) AS mean, (1 - h * (h + z)) / prec AS var, ln(mass) AS logmass FROM ({hazard})"


def _vb_sql(tri: bool, iterations: int) -> str:
    """One factor (and one middle value) with all rates 1, precision of the noise Gamma(1, 1)."""
    tables = [f"t0 AS MATERIALIZED ({_moments('SELECT CAST(1 AS DOUBLE) AS mu, CAST(1 AS DOUBLE) AS prec')})"]
    first = "(SELECT mean FROM t0)", "(SELECT var FROM t0)"
    s = first if tri else ("1", "0")
    tables.append(f"b0 AS MATERIALIZED (SELECT i, j, r, {first[0]} AS u, {first[1]} AS uu, {first[0]} AS v, {first[1]} AS vv, CAST({s[0]} AS DOUBLE) AS s, CAST({s[1]} AS DOUBLE) AS ss FROM obs)")

    def error(n: int) -> str:
        return f"e{n} AS MATERIALIZED (SELECT *, 1 + n / 2.0 AS alpha, 1 + squares / 2 AS beta FROM (SELECT count(*) AS n, sum((r - u * s * v) ** 2) AS se, sum((r - u * s * v) ** 2 + (uu + u * u) * (ss + s * s) * (vv + v * v) - u * u * s * s * v * v) AS squares FROM b{n}))"

    tables.append(error(0))
    out = []
    for n in range(1, iterations + 1):
        t, at, factors = f"(SELECT alpha / beta FROM e{n - 1})", f"b{n - 1}", []
        for x, square, h, by in ([("s", "(uu + u * u) * (vv + v * v)", "u * v", None)] if tri else []) + [("u", "(ss + s * s) * (vv + v * v)", "s * v", "i"), ("v", "(ss + s * s) * (uu + u * u)", "s * u", "j")]:
            own = f"SELECT {by + ', ' if by else ''}(max({t}) * sum(r * {h}) - 1) / (max({t}) * sum({square})) AS mu, max({t}) * sum({square}) AS prec FROM {at}{' GROUP BY ' + by if by else ''}"
            tables.append(f"{x}f{n} AS MATERIALIZED ({_moments(own)})")
            factors.append(f"{x}f{n}")
            if by:
                made = f"SELECT c.* EXCLUDE ({x}, {x}{x}), f.mean AS {x}, f.var AS {x}{x} FROM {at} c JOIN {x}f{n} f USING ({by})"
            else:
                made = f"SELECT * EXCLUDE ({x}, {x}{x}), (SELECT mean FROM {x}f{n}) AS {x}, (SELECT var FROM {x}f{n}) AS {x}{x} FROM {at}"
            at = f"b{n}" if x == "v" else f"b{n}{x}"
            tables.append(f"{at} AS MATERIALIZED ({made})")
        tables.append(error(n))
        # digamma by its asymptotic series: alpha is half the number of cells.
        log_tau = "(ln(alpha) - 1 / (2 * alpha) - 1 / (12 * alpha ** 2) + 1 / (120 * alpha ** 4) - ln(beta))"
        noise = f"n / 2.0 * ({log_tau} - ln(2 * pi())) - alpha / beta / 2 * squares - alpha / beta - (alpha * ln(beta) - lgamma(alpha) + (alpha - 1) * {log_tau} - alpha)"
        own = " + ".join(f"(SELECT sum(-mean - ln(prec) / 2 + ln(2 * pi()) / 2 + logmass + prec / 2 * (var + (mean - mu) ** 2)) FROM {f})" for f in factors)
        out.append(f"SELECT {n - 1} AS iteration, round(se / n, 4) AS mse, round(alpha / beta, 7) AS tau, round({noise} + {own}, 2) AS elbo FROM e{n}")
    return f"{obs_sql()}, {', '.join(tables)} {' UNION ALL '.join(out)}"


def _vb_history(tri: bool, iterations: int) -> None:
    def run(spark, sf_dir):
        """Errors, precision of the noise and evidence bound after each number of iterations of a fit on executors."""
        sides, out = spark_sides(*observed(spark, sf_dir)), []
        try:
            for n in range(1, iterations + 1):
                fit = Factorizer("vb", 1, 1 if tri else None, Priors(rows=1.0, columns=1.0, middle=1.0)).fit(*sides, n, every=n)
                out.append((n - 1, round(float(fit.history[-1]["MSE"]), 4), round(float(fit.tau), 7), round(float(fit.elbo), 2)))
        finally:
            for s in sides:
                s.close()
        return spark.createDataFrame(out, "iteration int, mse double, tau double, elbo double")

    run.__name__ = f"vb_{'nmtf' if tri else 'nmf'}_one_factor"
    query(_vb_sql(tri, iterations))(run)


_vb_history(False, 2)
_vb_history(True, 2)


# --- Gibbs: what holds whatever is drawn ------------------------------------------------------------------------------------------


@query("SELECT unnest(['u', 'v', 's', 'tau']) AS name, true AS equal, true AS nonnegative")
def gibbs_thinned_sums(spark, sf_dir):
    """The running sums of thinned samples against the means of all kept samples, with one seed."""
    import numpy as np

    cells = _cells(spark, sf_dir)
    make = lambda thinned: Factorizer("gibbs", 2, 2, Priors(), "exp", seed=42, thinned=thinned).fit(*cells.sides(), 30, cells, every=30)
    kept, summed = make(None).factors(10, 4), make((10, 4)).factors(10, 4)
    rows = [(name, bool(np.allclose(a, b, rtol=1e-9, atol=0)), bool((np.asarray(a) >= 0).all())) for name, a, b in zip(("u", "v", "s", "tau"), kept, summed)]
    return spark.createDataFrame(rows, "name string, equal boolean, nonnegative boolean")
