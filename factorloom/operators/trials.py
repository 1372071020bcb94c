"""Model selection and cross-validation: trials run in parallel, one model to a task.

A trial is a small dict (size, fold, restart, seed); the matrix is broadcast once, and each task fits its model on
the cells that its trial trains on. Everything that must be compared comes back as a few numbers a trial.

A matrix that is too large for that is a batched.FoldedMatrix: every search and cross-validation here takes one in place
of Cells, and its models are fitted side by side on executors, over the folds that it carries.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .models import METRICS, Cells, Factorizer, Priors
from .tables import exists

#: Cells of a matrix that may be broadcast to all tasks.
BROADCAST_CELLS = 50_000_000
#: Bytes that trials which run at once may hold in all, and what a trial takes for each cell.
TRIAL_BYTES, TRIAL_CELL = 3 << 30, 110


def run_trials(spark: SparkSession, shared, trials: list[dict], work, at_a_time: int | None = None) -> list[dict]:
    """work(shared, trial) -> dict, one task for each trial, all in one job; a trial that fails has "error" in its result.
    at_a_time: at most so many tasks, each for several trials."""
    if not trials:
        return []
    cells = sum(len(x.r) for x in (shared if isinstance(shared, tuple) else (shared,)) if isinstance(x, Cells))
    if cells > BROADCAST_CELLS:
        raise ValueError(f"{cells} cells exceed the broadcast bound of {BROADCAST_CELLS}: fit on executors instead")
    sent = spark.sparkContext.broadcast((shared, [json.dumps(t) for t in trials]))

    def run(batches):
        for b in batches:
            for no in b.column(0).to_pylist():
                shared, specs = sent.value
                try:
                    out = work(shared, json.loads(specs[no]))
                except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                    out = {"error": str(e)}
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([json.dumps(out)], pa.string())], ["no", "out"])

    try:  # a few numbers come back from each trial
        done = {r.no: json.loads(r.out) for r in spark.range(0, len(trials), 1, min(len(trials), at_a_time or len(trials))).mapInArrow(run, "no long, out string").collect()}
    finally:
        sent.destroy()
    return [t | done[k] for k, t in enumerate(trials)]


def part(cells: Cells, keep: np.ndarray) -> Cells:
    return Cells(cells.i[keep], cells.j[keep], cells.r[keep], cells.n_rows, cells.n_columns)


def fold_numbers(cells: Cells, n_folds: int, seed: int, attempts: int = 100) -> np.ndarray:
    """A fold for each cell such that every training part covers all rows and columns: by drawing again, and where that
    fails, by construction (the cells of a cover are in no fold, -1, and always train)."""
    n = len(cells.r)
    for k in range(attempts):
        rank = np.random.default_rng([seed, k, 41]).permutation(n)
        fold = ((rank + 1) * n_folds - 1) // n
        if all(len(np.unique(at[fold != f])) == size for f in range(n_folds) for at, size in ((cells.i, cells.n_rows), (cells.j, cells.n_columns))):
            return fold
    rest = np.flatnonzero(~cover_of(cells, seed))
    if not len(rest):
        raise ValueError(f"Failed to generate folds for training and test data, {attempts} attempts, {n_folds} folds: each cell is needed to cover its row or column.")
    fold = np.full(n, -1)
    fold[rest] = ((np.random.default_rng([seed, 43]).permutation(len(rest)) + 1) * n_folds - 1) // len(rest)
    return fold


def cover_of(cells: Cells, seed: int) -> np.ndarray:
    """Whether each cell is the first of its row or column in a random order."""
    order = np.random.default_rng([seed, 47]).permutation(len(cells.r))
    out = np.zeros(len(order), bool)
    for at in (cells.i, cells.j):
        out[order[np.unique(at[order], return_index=True)[1]]] = True
    return out


@dataclass
class Setup:
    """How the models of a search are made and run."""

    method: str
    priors: Priors = field(default_factory=Priors)
    init: str | None = None
    init_middle: str | None = None
    iterations: int = 100
    burn_in: int | None = None
    thinning: int | None = None
    least: float = 0.0
    expo_prior: float = 1.0
    restarts: int = 1
    seed: int = 0

    def model(self, k: int, l: int | None, seed: int) -> Factorizer:
        return Factorizer(self.method, k, l, self.priors, self.init, self.init_middle, seed, self.least, self.expo_prior)

    def fit(self, cells: Cells, k: int, l: int | None, seed: int):
        return self.model(k, l, seed).fit(*cells.sides(), self.iterations, cells, every=self.iterations)

    def kept(self) -> dict:
        return {"burn_in": self.burn_in, "thinning": self.thinning} if self.method == "gibbs" and self.burn_in is not None else {}


def _fit_trial(shared, trial):
    """Quality on the training part, and errors on the fold left out (if any)."""
    setup, cells, fold = shared
    train, tested = cells, None
    if trial.get("fold") is not None:
        keep = fold != trial["fold"]
        if trial.get("inner") is not None:
            inner = np.full(len(keep), -1)
            inner[keep] = fold_numbers(part(cells, keep), trial["inner_folds"], trial["fold_seed"])
            train, tested = part(cells, keep & (inner != trial["inner"])), keep & (inner == trial["inner"])
        else:
            train, tested = part(cells, keep), ~keep
    fit = setup.fit(train, trial["K"], trial.get("L"), trial["seed"])
    kept = setup.kept()
    out = {m: fit.quality(m, train, **kept) for m in METRICS}
    if tested is not None:  # taken out only now: the fit needs the room
        out["test"] = fit.predict(part(cells, tested), **kept)
    return out


def narrow(cells: Cells, fold: np.ndarray | None) -> tuple[Cells, np.ndarray | None]:
    """The same with the smallest integers that hold the numbers: each task has them all."""
    i, j = (at.astype(np.min_scalar_type(-max(n, 1))) for at, n in ((cells.i, cells.n_rows), (cells.j, cells.n_columns)))
    small = fold if fold is None or not len(fold) else fold.astype(np.min_scalar_type(-int(fold.max()) - 2))
    return Cells(i, j, cells.r, cells.n_rows, cells.n_columns), small


def at_once(cells: Cells) -> int:
    """Trials whose cells TRIAL_BYTES hold in all, or one."""
    return max(1, TRIAL_BYTES // (TRIAL_CELL * max(len(cells.r), 1)))


def runner(spark: SparkSession, cells, fold=None):
    """run(setup, trials) -> results, over a matrix in this process or on executors."""
    if isinstance(cells, Cells):
        few, small = narrow(cells, fold)
        return lambda setup, trials: run_trials(spark, (setup, few, small), trials, _fit_trial, at_once(cells))
    return cells.run


def _folded(spark: SparkSession, cells, folds: int, seed: int):
    """A runner over folds of the cells (those that a FoldedMatrix carries)."""
    return runner(spark, cells, fold_numbers(cells, folds, seed) if isinstance(cells, Cells) else None)


class Logged:
    """Trials over a matrix (in this process, with the fold of each cell, or a FoldedMatrix) that are kept in a table.

    A trial is named by the matrix's name, the setup and all that makes the trial; its result is written once, after each
    wave of trials. What an earlier run has written, whole or stopped half way, is read and not run again: the table of
    wanted trials is anti-joined with it. Searches and cross-validations take it in place of the matrix."""

    def __init__(self, spark: SparkSession, cells, path: str, name: str, fold=None, wave: int = 64):
        self.spark, self.cells, self.path, self.name, self.fold, self.wave = spark, cells, path, name, fold, wave
        self.ran = 0

    SCHEMA = "key string, name string, K int, L int, fold int, restart int, error string, result string"

    def frame(self) -> DataFrame:
        """All that is written, a row for each trial (one of those that two runs at once have both written)."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).dropDuplicates(["key"])

    def key(self, setup: Setup, trial: dict) -> str:
        plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else x.__dict__
        return json.dumps([self.name, setup, trial], sort_keys=True, default=plain)

    def run(self, setup: Setup, trials: list[dict]) -> list[dict]:
        keys = [self.key(setup, t) for t in trials]
        if not keys:
            return []
        wanted = self.spark.createDataFrame(list(enumerate(keys)), "no int, key string")
        missing = sorted(r.no for r in wanted.join(self.frame().select("key"), "key", "left_anti").select("no").collect())
        run = runner(self.spark, self.cells, self.fold)
        for at in range(0, len(missing), self.wave):
            some = missing[at : at + self.wave]
            rows = []
            for no, r in zip(some, run(setup, [trials[no] for no in some])):
                own = {k: v for k, v in r.items() if k not in trials[no]}
                rows.append((keys[no], self.name, r["K"], r.get("L"), r.get("fold"), r.get("restart"), r.get("error"), json.dumps(own)))
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.ran += len(some)
        done = {r.no: json.loads(r.result) for r in wanted.join(self.frame().select("key", "result"), "key").select("no", "result").collect()}
        return [t | done[no] for no, t in enumerate(trials)]

    def within(self, fold: int, folds: int, seed: int) -> Logged:
        """The training part of a fold, with folds of its own, in the same table."""
        name = f"{self.name}/{fold}"
        if isinstance(self.cells, Cells):
            inner = part(self.cells, self.fold != fold)
            return Logged(self.spark, inner, self.path, name, fold_numbers(inner, folds, seed), self.wave)
        return Logged(self.spark, self.cells.within(fold, folds, seed), self.path, name, None, self.wave)

    def close(self) -> None:
        if not isinstance(self.cells, Cells):
            self.cells.close()


def _trial(setup: Setup, k: int, l: int | None, restart: int, **more) -> dict:
    return {"K": k, "L": l, "restart": restart, "seed": hash((setup.seed, k, l or 0, restart, *sorted(v for v in more.values() if v is not None))) % 2**31, **more}


def likelihood(r: dict) -> float:
    """For comparison: a restart without one (NaN) comes last."""
    return -math.inf if math.isnan(r["loglikelihood"]) else r["loglikelihood"]


class Search:
    """Results by size: for each, the restart with the greatest log-likelihood."""

    def __init__(self, setup: Setup):
        self.setup, self.results = setup, {}

    def _take(self, rows: list[dict]) -> None:
        for r in rows:
            if "error" not in r:
                at = (r["K"], r["L"])
                if at not in self.results or likelihood(r) > likelihood(self.results[at]):
                    self.results[at] = r

    def _run(self, spark, cells, sizes, fold=None, number=None) -> None:
        more = {} if number is None else {"fold": number}
        todo = [_trial(self.setup, k, l, n, **more) for k, l in sizes if (k, l) not in self.results for n in range(self.setup.restarts)]
        self._take(runner(spark, cells, fold)(self.setup, todo))

    def all_values(self, metric: str) -> list[tuple]:
        if metric not in METRICS:
            raise ValueError(f"Unrecognised metric name: {metric}.")
        return [(k, l, r[metric]) for (k, l), r in self.results.items()]

    def best_value(self, metric: str):
        """The size of the least value (the first of equals), as K or (K, L). NaN counts as the greatest."""
        k, l, _ = min(self._found(metric), key=lambda v: math.inf if math.isnan(v[2]) else v[2])
        return k if l is None else (k, l)

    def _found(self, metric: str) -> list[tuple]:
        found = self.all_values(metric)
        if not found:
            raise ValueError("No size was fitted: all trials failed.")
        return found

    def best(self, metric: str):
        """Like best_value, but the greatest of what is to be maximised (log-likelihood, ELBO)."""
        sign = -1 if metric in ("loglikelihood", "ELBO") else 1
        k, l, _ = min(self._found(metric), key=lambda v: math.inf if math.isnan(v[2]) else sign * v[2])
        return k if l is None else (k, l)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, l, m, float(r[m])) for (k, l), r in self.results.items() for m in METRICS]
        return spark.createDataFrame(rows, "K int, L int, metric string, value double")


class LineSearch(Search):
    def __init__(self, setup: Setup, values_k: list[int]):
        super().__init__(setup)
        self.values = values_k

    def search(self, spark, cells: Cells) -> LineSearch:
        self._run(spark, cells, [(k, None) for k in self.values])
        return self


class GridSearch(Search):
    def __init__(self, setup: Setup, values_k: list[int], values_l: list[int]):
        super().__init__(setup)
        self.values = [(k, l) for k in values_k for l in values_l]

    def search(self, spark, cells: Cells) -> GridSearch:
        self._run(spark, cells, self.values)
        return self


class GreedySearch(Search):
    """From the first sizes, step to the best of the next K, the next L and both, while one is no worse than here; then
    along the edge. A step's candidates run as one job, and each size is evaluated once."""

    def __init__(self, setup: Setup, values_k: list[int], values_l: list[int]):
        super().__init__(setup)
        self.values_k, self.values_l = sorted(values_k), sorted(values_l)

    def search(self, spark, cells, metric: str, fold=None, number=None) -> GreedySearch:
        for sizes in self.steps(metric):
            self._run(spark, cells, sizes, fold, number)
        return self

    def steps(self, metric: str):
        """The sizes that must be known next; their results are to be taken before the next step is asked for."""
        a = b = 0
        at = lambda x, y: (self.values_k[x], self.values_l[y])

        def value(x, y):
            r = self.results.get(at(x, y))
            return math.inf if r is None or math.isnan(r[metric]) else r[metric]

        while True:
            steps = [(x, y) for x, y in ((a + 1, b), (a, b + 1), (a + 1, b + 1)) if x < len(self.values_k) and y < len(self.values_l)]
            yield [at(a, b), *(at(*s) for s in steps)]
            if not steps:
                return
            best = min(steps, key=lambda s: value(*s))
            if value(a, b) < value(*best):
                return
            a, b = best


def mean_of(rows: list[dict]) -> dict[str, float]:
    return {m: float(np.mean([r[m] for r in rows])) for m in ("MSE", "R^2", "Rp")}


def _refit(run, setup: Setup, chosen: dict[int, tuple]) -> list[dict]:
    trials = [_trial(setup, *size, n, fold=f, refit=1) for f, size in chosen.items() for n in range(setup.restarts)]
    rows = [r for r in run(setup, trials) if "error" not in r]
    out = []
    for f in chosen:
        own = [r for r in rows if r["fold"] == f]
        if not own:
            raise ValueError(f"All restarts failed on fold {f}, of size {chosen[f]}.")
        out.append(max(own, key=likelihood))
    return out


@dataclass
class CrossValidated:
    performances: list[dict]
    average: dict[str, float]
    chosen: dict[int, tuple]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The log: a row for each fold and metric."""
        rows = [(f, *map(int, (k, l or 0)), m, float(p[m])) for (f, (k, l)), p in zip(self.chosen.items(), self.performances) for m in ("MSE", "R^2", "Rp")]
        return spark.createDataFrame(rows, "fold int, K int, L int, metric string, value double")


def line_search_cv(spark, cells, setup: Setup, values_k: list[int], folds: int, metric: str = "AIC") -> CrossValidated:
    """For each fold, the best size on its training part by the metric, refitted and judged on the fold; all folds at once."""
    run = _folded(spark, cells, folds, setup.seed)
    rows = run(setup, [_trial(setup, k, None, n, fold=f) for f in range(folds) for k in values_k for n in range(setup.restarts)])
    chosen = {}
    for f in range(folds):
        search = Search(setup)
        search._take([r for r in rows if r["fold"] == f])
        chosen[f] = (search.best_value(metric), None)
    best = [r["test"] for r in _refit(run, setup, chosen)]
    return CrossValidated(best, mean_of(best), chosen)


def greedy_search_cv(spark, cells, setup: Setup, values_k: list[int], values_l: list[int], folds: int, metric: str = "AIC", select_on: str = "train") -> CrossValidated:
    """The same for the tri-factorisation by greedy search: all folds take a step at once. select_on "all" lets the search
    see the test cells too."""
    run = _folded(spark, cells, folds, setup.seed)
    searches = {f: GreedySearch(setup, values_k, values_l) for f in range(folds)}
    steps = {f: s.steps(metric) for f, s in searches.items()}
    while steps:
        todo = []
        for f in list(steps):
            sizes = next(steps[f], None)
            if sizes is None:
                del steps[f]
                continue
            more = {"fold": f} if select_on == "train" else {}
            todo += [(f, _trial(setup, *size, n, **more)) for size in sizes if size not in searches[f].results for n in range(setup.restarts)]
        for (f, _), r in zip(todo, run(setup, [t for _, t in todo])):
            searches[f]._take([r])
    chosen = {f: s.best_value(metric) for f, s in searches.items()}
    best = [r["test"] for r in _refit(run, setup, chosen)]
    return CrossValidated(best, mean_of(best), chosen)


def matrix_cv(spark, cells, setup: Setup, parameters: list[dict], folds: int) -> dict[str, dict]:
    """For each parameter set (K, L) the mean errors over folds, by its JSON; failed sets have an error instead. All trials at once."""
    run = _folded(spark, cells, folds, setup.seed)
    return averaged(run(setup, [_trial(setup, p["K"], p.get("L"), 0, fold=f) for p in parameters for f in range(folds)]), parameters)


def averaged(rows: list[dict], parameters: list[dict]) -> dict[str, dict]:
    out = {}
    for p in parameters:
        own = [r for r in rows if (r["K"], r["L"]) == (p["K"], p.get("L"))]
        failed = [r["error"] for r in own if "error" in r]
        out[json.dumps(p, sort_keys=True)] = {"error": failed[0]} if failed else mean_of([r["test"] for r in own]) | {"folds": [r["test"] for r in own]}
    return out


def find_best(performances: dict[str, dict], criterion: str = "MSE", low_better: bool = True) -> dict:
    """The parameter set of the best average; failed sets and NaN come last."""
    sign = 1 if low_better else -1
    value = lambda v: math.inf if "error" in v or math.isnan(v[criterion]) else sign * v[criterion]
    return json.loads(min(performances, key=lambda k: value(performances[k])))


def nested_cv(spark, cells, setup: Setup, parameters: list[dict], folds: int, inner_folds: int | None = None) -> CrossValidated:
    """Outer folds are judged with the parameter set that does best on inner folds of their training part. In this process,
    two jobs in all; on executors, each training part is packed anew."""
    inner_folds = inner_folds or folds
    run = _folded(spark, cells, folds, setup.seed)
    inner = lambda f: [_trial(setup, p["K"], p.get("L"), 0, fold=f, inner=n, inner_folds=inner_folds, fold_seed=setup.seed + 1 + f) for p in parameters for n in range(inner_folds)]
    rows = []
    if isinstance(cells, Cells):
        rows = run(setup, [t for f in range(folds) for t in inner(f)])
    else:
        for f in range(folds):
            part = cells.within(f, inner_folds, setup.seed + 1 + f)
            try:
                rows += [r | {"fold": f} for r in part.run(setup, [t | {"fold": t["inner"]} for t in inner(f)])]
            finally:
                part.close()
    chosen = {}
    for f in range(folds):
        best = find_best(averaged([r for r in rows if r["fold"] == f], parameters))
        chosen[f] = (best["K"], best.get("L"))
    out = [r["test"] for r in _refit(run, setup, chosen)]
    return CrossValidated(out, mean_of(out), chosen)
