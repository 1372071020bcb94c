"""Many models over one matrix on executors: the folds and sizes of a search side by side.

The cells of a FoldedMatrix are packed once by row and once by column, each with its fold. A model leaves out the cells of
its fold. Its loop is that of models.py and knows nothing of the others: it runs in a thread of its own and asks its two
sides for results over blocks. When all models have asked, one pass over the packed rows answers all of them, cutting each
block once for each fold. A pass sends at most sides.BROADCAST_BYTES of factors; more models take several.

Cases: cells of fold -1 train in every model. A fold without which a row or column has no cell is refused, by its number. A
model that fails has an "error" in its result and does not stop the others. Columns other than i, j, r, fold are left out.
"""

from __future__ import annotations

import pickle
import queue
import threading

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sides
from .masks import covering_folds, lost_lines, training
from .metrics import from_sums
from .models import METRICS, check_numbers
from .tables import deleted, written

#: Models whose loops run at once.
AT_ONCE = 64


class _Side:
    """What a model sees of one side: rows() and sums() that wait for the pass."""

    whole = False

    def __init__(self, ask, side: int, n: int, fold: int | None):
        self.ask, self.side, self.n, self.fold = ask, side, n, fold

    def rows(self, fn, *shared) -> np.ndarray:
        return self.ask((self.side, False, self.fold, fn, shared, self.n))

    def sums(self, fn, *shared):
        return self.ask((self.side, True, self.fold, fn, shared, self.n))


class FoldedMatrix:
    """obs(i, j, r, fold) of n_rows x n_columns, packed on executors."""

    def __init__(self, folded: DataFrame, n_rows: int, n_columns: int, owned: bool = False):
        """owned: folded is a written table that close() deletes."""
        if not owned:  # read several times here: written once, not made again each time
            folded = written(folded)
        cells = check_numbers(folded, n_rows, n_columns)
        for axis, what in (("i", "row"), ("j", "column")):
            lost = lost_lines(folded, axis).first()
            if lost is not None:
                raise ValueError(f"Fully unobserved {what} in the training part of fold {lost.fold}, {what} {lost[axis]}.")
        self.folded, self.n = folded, (n_rows, n_columns)
        self.packed = [sides.pack(folded, a, b, tag="fold", cells=cells).persist() for a, b in (("i", "j"), ("j", "i"))]
        self.passes = 0

    @classmethod
    def of(cls, obs: DataFrame, n_rows: int, n_columns: int, folds: int, seed: int) -> FoldedMatrix:
        """With folds whose training parts cover all rows and columns."""
        return cls(covering_folds(obs, folds, seed), n_rows, n_columns, owned=True)

    def within(self, fold: int, folds: int, seed: int) -> FoldedMatrix:
        """The training part of a fold, with folds of its own."""
        return FoldedMatrix.of(training(self.folded, fold).drop("fold"), *self.n, folds, seed)

    def close(self) -> None:
        for p in self.packed:
            p.unpersist()
        deleted(self.folded)

    # -- models side by side --

    def fits(self, works: list, folds: list[int | None]) -> list:
        """work(rows, columns) of each model, whose fold is left out: their results, or the errors that they raised."""
        out = []
        for at in range(0, len(works), AT_ONCE):
            out += self._together(works[at : at + AT_ONCE], folds[at : at + AT_ONCE])
        return out

    def _together(self, works: list, folds: list[int | None]) -> list:
        said: queue.Queue = queue.Queue()
        replies = [queue.Queue() for _ in works]

        def model(no: int) -> None:
            def ask(request):
                said.put((no, request, None))
                answer = replies[no].get()
                if isinstance(answer, BaseException):
                    raise answer
                return answer

            try:
                result = works[no](_Side(ask, 0, self.n[0], folds[no]), _Side(ask, 1, self.n[1], folds[no]))
            except Exception as e:  # given to the caller with the model's number
                result = e
            said.put((no, None, result))

        for no in range(len(works)):
            threading.Thread(target=model, args=(no,), daemon=True).start()
        results, waiting, live = [None] * len(works), {}, len(works)
        while live:
            no, request, result = said.get()
            if request is None:
                results[no], live = result, live - 1
            else:
                waiting[no] = request
            if waiting and len(waiting) == live:  # only this thread speaks to Spark
                try:
                    answers = self._answer(waiting)
                except Exception as e:
                    for n in waiting:
                        replies[n].put(InterruptedError("the pass failed"))
                    raise e
                for n, answer in answers.items():
                    replies[n].put(answer)
                waiting = {}
        return results

    def _answer(self, waiting: dict) -> dict:
        out = {}
        for side in (0, 1):
            asked = [(no, r) for no, r in sorted(waiting.items()) if r[0] == side]
            while asked:
                size, part = 0, []
                while asked:
                    own = sum(x.nbytes for x in asked[0][1][4] if isinstance(x, np.ndarray))
                    if own > sides.BROADCAST_BYTES:
                        raise ValueError(f"factors of {own} bytes exceed the broadcast bound of {sides.BROADCAST_BYTES}")
                    if part and size + own > sides.BROADCAST_BYTES:
                        break
                    size += own
                    part.append(asked.pop(0))
                out |= self._pass(side, part)
        return out

    def _pass(self, side: int, asked: list) -> dict:
        self.passes += 1
        packed = self.packed[side]
        sent = packed.sparkSession.sparkContext.broadcast([r[4] for _, r in asked])
        plan = [(summed, fold, fn) for _, (_, summed, fold, fn, _, _) in asked]

        def packet(x):
            return pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(x)], pa.binary())], ["out"])

        def run(batches):
            first, totals = None, {}
            for ids, counts, idx, val, tag in sides.slices(batches):
                blocks, found = {}, []
                for no, ((summed, fold, fn), shared) in enumerate(zip(plan, sent.value)):
                    if fold not in blocks:
                        blocks[fold] = K.Block.parted(ids, counts, idx, val, None if fold is None else tag == fold)
                    value = fn(blocks[fold], *shared)
                    if summed:
                        totals[no] = sides.add(totals.get(no), value)
                    else:
                        found.append((no, value))
                first = int(ids[0]) if first is None else min(first, int(ids[0]))
                if found:
                    yield packet((ids, found))
            if totals:
                yield packet((first, totals))

        try:
            rows = [pickle.loads(r.out) for r in packed.mapInArrow(run, "out binary").collect()]
        finally:
            sent.destroy()
        out = {}
        for _, totals in sorted((r for r in rows if isinstance(r[1], dict)), key=lambda r: r[0]):
            for no, value in totals.items():
                out[no] = sides.add(out.get(no), value)
        for ids, found in (r for r in rows if isinstance(r[1], list)):
            for no, value in found:
                if no not in out:
                    out[no] = np.zeros((asked[no][1][5], *value.shape[1:]))
                out[no][ids] = value
        return {asked[no][0]: value for no, value in out.items()}

    # -- trials, as trials.py makes them --

    def run(self, setup, trials: list[dict]) -> list[dict]:
        """For each trial (K, L, seed, and fold or None) its quality on the training part and its errors on the fold."""

        def work(trial):
            def fitted(rows, columns):
                fit = setup.model(trial["K"], trial.get("L"), trial["seed"]).fit(rows, columns, setup.iterations, every=setup.iterations)
                kept = setup.kept()
                u, v, s, _ = fit.factors(**kept)
                both = rows.sums(K.fit_both, u if s is None else u @ s, v)
                out = {m: fit.quality_of(m, both["train"], **kept) for m in METRICS}
                return out | ({"test": from_sums(both["test"])} if "test" in both else {})

            return fitted

        done = self.fits([work(t) for t in trials], [t.get("fold") for t in trials])
        for d in done:
            if isinstance(d, Exception) and not isinstance(d, (ValueError, ArithmeticError, np.linalg.LinAlgError)):
                raise d
        return [t | ({"error": str(d)} if isinstance(d, Exception) else d) for t, d in zip(trials, done)]

    def sizes(self) -> DataFrame:
        return self.folded.groupBy("fold").agg(F.count("*").alias("cells"))
