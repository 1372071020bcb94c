"""Fits whose factors are tables, for matrices of which a factor is too large to be broadcast.

Rows and columns are cut into blocks of consecutive numbers. A block of rows holds its cells, and which rows of the other
factor they need; from that a routing table says, for each block of the other factor, which of its rows go to which block.
A half-sweep joins the other factor with the routing table, sends each block the rows that it needs, updates the block's
own factor beside its cells, and writes the new factor; sums over the cells (errors, what the middle factor and the bound
need) are made in the same pass, by blocks, and added up in tasks. The driver holds the middle factor, the precision and
the history, whatever the number of rows.

The updates are those of kernels.py, so a fit gives what models.py gives from the same beginning. The multiplicative update
of the middle factor is the joint one (Factorizer(joint=True)), which needs one pass.

A block holds at most ROWS rows, fewer where rows have many cells (BLOCK_CELLS on the mean, or one row). The cells of a block
that has more than BLOCK_CELLS lie in several parts, each in a task of its own. On a side with such a block a pass takes sums
over parts, adds them up by block and chooses the new factor (the multiplicative update factor by factor, as each needs the
one before); sums over the cells then need one more pass.

Cases: as spark_sides(): each row and column must have a cell, numbers run from 0. Priors are numbers, not matrices. A part's
sums, rows x factors x factors, of all parts of a block are added up in one task. Columns other than i, j, r are left out. "kmeans" beginnings need the assignment of every row and are not made here.
"""

from __future__ import annotations

import copy
import pickle
import time

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import RowDraws, gamma_draw, gamma_expectation, gamma_expectation_log, gamma_mode, tn_moments
from . import kernels as K
from .metrics import from_sums
from .models import Factorizer, check_numbers
from .sides import add
from .tables import deleted, written

#: Rows of a block, cells of a part of it; blocks that one row of a routing table serves; tasks that add up sums; bytes of routes
#: that are sent at once.
ROWS, BLOCK_CELLS, TARGETS, SUM_TASKS, ROUTE_BYTES = 4096, 1 << 19, 64, 32, 1 << 22


class BlockedSide:
    """One side of a matrix: its blocks of cells in parts, and the routing of the other side's rows to them."""

    def __init__(self, obs: DataFrame, by: str, other: str, n: int, rows: int, other_rows: int, n_cells: int):
        self.n, self.size, self.n_cells = n, rows, n_cells
        self.blocks = -(-n // rows)
        spark = obs.sparkSession
        # Consecutive rows of the other side that stay together: a sixteenth of a part's cells at most, or one row.
        width = max(1, min(other_rows, BLOCK_CELLS // (16 * rows)))

        def pack(cells: pa.Table) -> pa.Table:
            i, j, r = (cells.column(c).to_numpy() for c in range(3))
            b = int(i[0]) // rows
            i = i - b * rows
            order = np.lexsort((j, i))
            needs, idx = np.unique(j[order], return_inverse=True)
            counts = np.bincount(i, minlength=min(rows, n - b * rows))
            p = cells.column(3)[0].as_py()
            lists = [counts.astype(np.int32), idx.astype(np.int32), r[order], needs]
            return pa.table([pa.array([b], pa.int32()), pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in lists)], names=["b", "p", "counts", "idx", "vals", "needs"])

        def route(batches):
            def sent():
                return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in (source, to, parts)), pa.array(at, pa.binary())], ["c", "b", "p", "at"])

            for batch in batches:
                source, to, parts, at, size = [], [], [], [], 0
                for b, p, needs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    needs = np.frombuffer(needs.as_buffer(), np.int64)
                    cut = np.flatnonzero(np.diff(needs // other_rows)) + 1
                    for part in np.split(needs, cut):
                        to.append(b)
                        parts.append(p)
                        source.append(int(part[0]) // other_rows)
                        at.append((part % other_rows).astype(np.int32).tobytes())
                    size += 4 * len(needs)
                    if size > ROUTE_BYTES:
                        yield sent()
                        source, to, parts, at, size = [], [], [], [], 0
                yield sent()

        block = F.floor(F.col("i") / rows).cast("int")
        cells = obs.select(F.col(by).cast("bigint").alias("i"), F.col(other).cast("bigint").alias("j"), F.col("r").cast("double").alias("r"))
        # At most one row for each BLOCK_CELLS cells, so it may be broadcast.
        counted = cells.groupBy(block.alias("b")).count().where(F.col("count") > BLOCK_CELLS)
        large = written(counted.select("b", F.ceil(F.col("count") / BLOCK_CELLS).alias("parts")), n_cells)
        self.split = not large.isEmpty()
        if self.split:
            cells = cells.join(F.broadcast(large), block == F.col("b"), "left")
        part = F.coalesce(F.pmod(F.floor(F.col("j") / width), F.col("parts")), F.lit(0)) if self.split else F.lit(0)
        cells = cells.select("i", "j", "r", part.cast("int").alias("p"))
        packed = cells.groupBy(block.alias("b"), "p").applyInArrow(pack, "b int, p int, counts binary, idx binary, vals binary, needs binary")
        self.table = written(packed, n_cells)
        deleted(large)
        routes = self.table.select("b", "p", "needs").mapInArrow(route, "c int, b int, p int, at binary")
        routes = routes.groupBy("c", F.floor(F.col("b") / TARGETS).alias("part")).agg(F.collect_list(F.struct("b", "p", "at")).alias("targets"))
        self.routes = written(routes.select("c", "targets"), n_cells)
        # Dealt by part once; what is lost of it is read again.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n_cells // BLOCK_CELLS))
        self.cells = self.table.select("b", "p", "counts", "idx", "vals").repartition(parts, "b", "p").persist()
        self.routing = self.routes.repartition(parts, "c").persist()

    def close(self) -> None:
        self.cells.unpersist()
        self.routing.unpersist()
        deleted(self.table, self.routes)

    def begun(self, spark, make) -> DataFrame:
        """A factor table (b, data, sums): make(ids) gives the rows x factors x planes of a block."""
        n, size = self.n, self.size

        def run(batches):
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    data = make(np.arange(b * size, min((b + 1) * size, n)))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data.tobytes()], pa.binary()), pa.array([None], pa.binary())], ["b", "data", "sums"])

        return written(spark.range(self.blocks).mapInArrow(run, "b int, data binary, sums binary"))

    def half(self, own: DataFrame, other: DataFrame, k: int, other_k: int, planes: int, needed: int, work) -> DataFrame:
        """A pass over this side: work(block, own, other) -> (new own or None, sums) for each part of a block, written (where
        no block has several parts, as a factor table)."""
        size = self.size

        def gather(batches):
            for batch in batches:
                for c, data, targets in zip(*batch.columns):
                    x = np.frombuffer(data.as_buffer()).reshape(-1, other_k, planes)[:, :, :needed]
                    sent = [(t["b"], t["p"], c.as_py(), np.ascontiguousarray(x[np.frombuffer(t["at"], np.int32)]).tobytes()) for t in targets.as_py()]
                    yield pa.RecordBatch.from_arrays([pa.array([s[m] for s in sent], kind) for m, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["b", "p", "c", "data"])

        def update(cells: pa.Table, pieces: pa.Table) -> pa.Table:
            b, part = (cells.column(c)[0].as_py() for c in ("b", "p"))
            counts, idx = (np.frombuffer(cells.column(c)[0].as_py(), np.int32).astype(np.int64) for c in ("counts", "idx"))
            vals = np.frombuffer(cells.column("vals")[0].as_py())
            order = np.argsort(pieces.column("c").to_numpy(), kind="stable")
            parts = [x.as_buffer() for x in pieces.column("data")]  # not copied
            mine = np.frombuffer(parts[order[0]]).reshape(-1, k, planes)  # its own factor is piece -1
            theirs, end = np.empty((sum(parts[p].size for p in order[1:]) // (8 * other_k * needed), other_k, needed)), 0
            for p in order[1:]:
                x = np.frombuffer(parts[p]).reshape(-1, other_k, needed)
                theirs[end : end + len(x)] = x
                end += len(x)
            block = K.Block(b * size + np.arange(len(mine)), counts, idx, vals, at=np.arange(len(mine)))
            new, sums = work(block, mine, theirs)
            return pa.table([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_bytes(new)], pa.binary()), pa.array([cloudpickle.dumps(sums)], pa.binary())], names=["b", "p", "data", "sums"])

        pieces = other.select(F.col("b").alias("c"), "data").join(self.routing, "c").mapInArrow(gather, "b int, p int, c int, data binary")
        own = own.select("b", "data").join(self.table.select("b", "p"), "b") if self.split else own.withColumn("p", F.lit(0))
        pieces = pieces.union(own.select("b", "p", F.lit(-1).alias("c"), "data"))
        return written(self.cells.groupBy("b", "p").cogroup(pieces.groupBy("b", "p")).applyInArrow(update, "b int, p int, data binary, sums binary"))

    def merged(self, own: DataFrame, found: DataFrame, k: int, planes: int, choose) -> DataFrame:
        """choose(rows, own, sums) -> (new own, sums) for each block, of the sums that its parts gave: a factor table."""
        size = self.size

        def run(mine: pa.Table, parts: pa.Table) -> pa.Table:
            b, sums = mine.column("b")[0].as_py(), None
            for _, x in sorted(zip(parts.column("p").to_pylist(), parts.column("sums")), key=lambda x: x[0]):
                sums = add(sums, pickle.loads(x.as_buffer()))
            x = np.frombuffer(mine.column("data")[0].as_buffer()).reshape(-1, k, planes)
            new, sums = choose(b * size + np.arange(len(x)), x, sums)
            return pa.table([pa.array([b], pa.int32()), pa.array([_bytes(new)], pa.binary()), pa.array([cloudpickle.dumps(sums)], pa.binary())], names=["b", "data", "sums"])

        both = own.select("b", "data").groupBy("b").cogroup(found.select("b", "p", "sums").groupBy("b"))
        return written(both.applyInArrow(run, "b int, data binary, sums binary"), self.n_cells)


def _bytes(x: np.ndarray | None) -> bytes | None:
    return None if x is None else np.ascontiguousarray(x).tobytes()


def total(table: DataFrame) -> dict:
    """The sums of all blocks, added up in a few tasks."""

    def run(batches):
        out = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                out = add(out, pickle.loads(x))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(out)], pa.binary())], ["sums"])

    out = None
    for r in table.select("sums").coalesce(SUM_TASKS).mapInArrow(run, "sums binary").collect():
        out = add(out, pickle.loads(r.sums))
    return out


class Work:
    """What a pass does on a block: an update of the side's own factor (or none), then sums."""

    def __init__(self, side: str, method: str | None, sums: tuple[str, ...], s=None, s_var=None, rate: float = 0.0, tau: float = 1.0, least: float = 0.0, key=None, order=None, kept: bool = False):
        self.side, self.method, self.sums, self.s, self.s_var = side, method, sums, s, s_var
        self.rate, self.tau, self.least, self.key, self.order, self.kept = rate, tau, least, key, order, kept

    def __call__(self, block: K.Block, own: np.ndarray, other: np.ndarray):
        x, seen = self._seen(own, other)
        if self.method is None:
            return None, self._sums(block, own, other, seen)
        if self.method == "np":
            new = self._kept(own, K.multiplicative(block, x, seen))
        else:
            new = self.chosen(block.ids, own, self.gathered(block, own, other))
        return new, self._sums(block, new, other, seen) | self._bound(new)

    def _seen(self, own, other):
        """Its own factor, and the other as its cells see it."""
        y, s = np.ascontiguousarray(other[:, :, 0]), self._middle(self.s)
        return np.ascontiguousarray(own[:, :, 0]), y if s is None else y @ s.T

    def _middle(self, s):
        return None if s is None else s if self.side == "u" else s.T

    def _kept(self, own, made):
        # A second plane holds the sum of the samples that are kept.
        return made[:, :, None] if own.shape[2] == 1 else np.stack((made, own[:, :, 1] + (made if self.kept else 0)), 2)

    def gathered(self, block: K.Block, own: np.ndarray, other: np.ndarray, step: int = 0) -> dict:
        """The sums over cells of which the new factor (np: its column of this number) is chosen."""
        x, seen = self._seen(own, other)
        if self.method == "np":
            return K.multiplied(block, x, seen, step)
        if self.method == "vb":
            return K.variational_sums(block, np.ascontiguousarray(other[:, :, 0]), np.ascontiguousarray(other[:, :, 1]), self._middle(self.s))
        return dict(zip("gb", block.gram(seen)))

    def chosen(self, ids: np.ndarray, own: np.ndarray, sums: dict, step: int = 0) -> np.ndarray:
        x = own[:, :, 0].copy()
        rate = np.full(x.shape, self.rate)
        if self.method == "vb":
            return K.expected(sums, x, rate, self.tau, self._middle(self.s), self._middle(self.s_var), self.order)
        if self.method == "np":
            with np.errstate(all="ignore"):
                x[:, step] = x[:, step] * sums["top"] / sums["low"]
            return self._kept(own, x)
        return self._kept(own, K.modes(**sums, own=x, rate=rate, tau=self.tau, least=self.least) if self.method == "icm" else K.draws(**sums, ids=ids, own=x, rate=rate, tau=self.tau, key=self.key))

    def steps(self, k: int):
        """(gather, choose) for the parts of blocks, one after another."""
        for step in range(k if self.method == "np" else 1):

            def gather(block, own, other, step=step):
                return None, self.gathered(block, own, other, step)

            def choose(ids, own, sums, step=step):
                new = self.chosen(ids, own, sums, step)
                return new, self._bound(new)

            yield gather, choose

    def summing(self) -> Work:
        """What remains once the factor is new."""
        out = copy.copy(self)
        out.method, out.sums = None, tuple(x for x in self.sums if x != "bound")
        return out

    def _bound(self, new) -> dict:
        return {"bound": Factorizer.factor_bound(np.full(new.shape[:2], self.rate), *(new[:, :, c] for c in range(4)))} if "bound" in self.sums else {}

    def _sums(self, block, new, other, seen) -> dict:
        x, y, s = new[:, :, 0], other[:, :, 0], self.s
        out = {}
        if "errors" in self.sums:
            out["errors"] = K.fit_sums(block, x, seen)
        if "middle" in self.sums:
            out |= K.middle_sums(block, x, y)
        if "joint" in self.sums:  # from the columns' side
            top, low = K.middle_joint(block, x, s.T, y).values()
            out |= {"top": top.T, "low": low.T}
        if "expected" in self.sums or "middle_vb" in self.sums:
            x_var, y_var = new[:, :, 1], other[:, :, 1]
            if "expected" in self.sums:
                out["expected"] = K.expected_error(block, x, x_var, y, y_var) if s is None else K.expected_error_tri(block, x, x_var, s.T, self.s_var.T, y, y_var)
            if "middle_vb" in self.sums:
                out |= _turned(K.middle_sums(block, x, y, x_var, y_var), x.shape[1], y.shape[1])
        return out


def _turned(sums: dict, l: int, k: int) -> dict:
    """Sums for the middle factor from the columns' side (l x k), as the rows' side gives them (k x l)."""
    p = sums["P"].reshape(l, k, l, k).transpose(1, 0, 3, 2).reshape(k * l, k * l)
    turn = lambda x: x.reshape(l, k).T.ravel()
    return {"P": p, "b": turn(sums["b"]), "T": turn(sums["T"]), "Q": sums["W"], "W": sums["Q"]}


class BlockedFit:
    """A fitted model: factor tables u and v (idx, vec), the middle factor, precision, bound, history."""

    def __init__(self, model: BlockedFactorizer):
        self.model, self.history, self.tau, self.elbo, self.s = model, [], 1.0, 0.0, None

    def _vectors(self, name: str, middle=None) -> DataFrame:
        """idx, vec of a factor (for Gibbs the mean of kept samples, where there are any)."""
        model = self.model
        side, table = model.sides[name], model.tables[name]
        k, planes, kept, size = model.width[name], model.planes, model.kept, side.size

        def run(batches):
            for batch in batches:
                for b, data in zip(*(c.to_pylist() for c in batch.columns)):
                    x = np.frombuffer(data).reshape(-1, k, planes)
                    x = x[:, :, 1] / kept if kept else x[:, :, 0]
                    x = x if middle is None else x @ middle
                    ends = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(b * size + np.arange(len(x))), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))], ["idx", "vec"])

        return table.select("b", "data").mapInArrow(run, "idx bigint, vec array<double>")

    @property
    def u(self) -> DataFrame:
        return self._vectors("u")

    @property
    def v(self) -> DataFrame:
        return self._vectors("v")

    def predicted(self, obs: DataFrame, name: str = "p") -> DataFrame:
        """obs(i, j, ...) with the prediction of each cell (null where the model lacks its row or column), by joins."""
        from .masks import unused

        left, right, i, j = (unused(obs, x) for x in ("_left", "_right", "_i", "_j"))
        s = self.s / self.model.kept if self.model.kept and self.s is not None else self.s
        u, v = self._vectors("u", s).toDF(i, left), self.v.toDF(j, right)
        out = obs.join(u, F.col("i") == F.col(i), "left").join(v, F.col("j") == F.col(j), "left")
        product = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return out.select(*(F.col(f"`{c}`") for c in obs.columns if c.lower() != name.lower()), product.alias(name))


class BlockedFactorizer(Factorizer):
    """A Factorizer that fits tables: fit_table(obs, n_rows, n_columns, iterations)."""

    def fit_table(self, obs: DataFrame, n_rows: int, n_columns: int, iterations: int, rows: int = ROWS) -> BlockedFit:
        spark = self.spark = obs.sparkSession
        if self.init == "kmeans":
            raise ValueError("kmeans does not begin a fit in blocks")
        rates = {"u": self.priors.rows, "v": self.priors.columns, "s": self.priors.middle}
        if any(np.ndim(r) for r in rates.values()):
            raise ValueError("priors of a fit in blocks are numbers")
        cells = check_numbers(obs, n_rows, n_columns)
        self.rates, self.width = rates, {"u": self.k, "v": self.l or self.k}
        self.planes = 4 if self.method == "vb" else 2 if self.method == "gibbs" and self.thinned else 1
        of = [max(1, min(rows, BLOCK_CELLS * n // max(cells, 1))) for n in (n_rows, n_columns)]
        self.sides = {"u": BlockedSide(obs, "i", "j", n_rows, *of, cells), "v": BlockedSide(obs, "j", "i", n_columns, *of[::-1], cells)}
        self.kept = 0
        self.tables = {name: self.sides[name].begun(spark, self._beginning(name)) for name in ("u", "v")}
        fit = BlockedFit(self)
        state = {}
        if self.l is not None:
            rate = self.priors.rate("middle", (self.k, self.l))
            state["s"] = self._start(self.init_middle or self.init, rate)
        began = time.time()
        run = {"np": self._np_table, "icm": self._icm_table, "gibbs": self._icm_table, "vb": self._vb_table}[self.method]
        try:
            for it, errors in enumerate(run(state, iterations)):
                fit.history.append({"iteration": it, "elapsed": time.time() - began, **from_sums(errors), "i_div": float(errors[7]), "elbo": state.get("elbo", 0.0)})
        finally:
            for side in self.sides.values():
                side.close()
        fit.s, fit.tau, fit.elbo = state.get("s_kept", state.get("s")), state.get("tau", 1.0), state.get("elbo", 0.0)
        return fit

    def _beginning(self, name: str):
        k, rate, planes = self.width[name], float(self.rates[name]), self.planes
        kind, key = self.init, (self.seed, 19, 0 if name == "u" else 1)
        own = self.expo_prior if self.method == "np" else rate
        uniform, tau, vb = self.method == "np" and kind == "random", float(self.tau_init), self.method == "vb"
        if kind not in ("ones", "exp", "random", "exponential"):
            raise ValueError(f"Unknown initialisation: {kind}.")

        def make(ids: np.ndarray) -> np.ndarray:
            if kind in ("ones", "exp"):
                x = np.full((len(ids), k), 1.0 if kind == "ones" else 1 / rate)
            else:
                draws, x = RowDraws(key, ids), np.empty((len(ids), k))
                for c in range(k):
                    draws.begin(c)
                    u = draws.random()
                    x[:, c] = u if uniform else -np.log1p(-u) / own
            out = np.zeros((len(ids), k, planes))
            out[:, :, 0] = x
            if vb:
                mean, var = tn_moments(x, np.full(x.shape, tau))
                for c, plane in enumerate((mean, var, x, np.full(x.shape, tau))):
                    out[:, :, c] = plane
            return out

        return make

    def _pass(self, name: str, work: Work) -> dict:
        """Update the table of this name (where the work has a method); the sums."""
        other = "v" if name == "u" else "u"
        side, k, sums = self.sides[name], self.width[name], {}

        def half(work) -> DataFrame:
            return side.half(self.tables[name], self.tables[other], k, self.width[other], self.planes, 2 if self.method == "vb" else 1, work)

        def replaced(made: DataFrame) -> None:
            deleted(self.tables[name])
            self.tables[name] = made

        if side.split and work.method is not None:
            for gather, choose in work.steps(k):
                found = half(gather)
                replaced(side.merged(self.tables[name], found, k, self.planes, choose))
                deleted(found)
            if "bound" in work.sums:
                sums = total(self.tables[name])
            work = work.summing()
            if not work.sums:
                return sums
        made = half(work)
        sums |= total(made)
        if work.method is None:
            deleted(made)
        else:
            replaced(made)
        return sums

    def _np_table(self, x, iterations):
        tri = self.l is not None
        joint = ("joint",) if tri else ()
        sums = self._pass("v", Work("v", None, joint, x["s"])) if tri else {}
        for _ in range(iterations):
            if tri:
                with np.errstate(all="ignore"):
                    x["s"] = x["s"] * sums["top"] / sums["low"]
            self._pass("u", Work("u", "np", (), x.get("s")))
            sums = self._pass("v", Work("v", "np", ("errors", *joint), x.get("s")))
            yield sums["errors"]

    def _icm_table(self, x, iterations):
        gibbs, tri = self.method == "gibbs", self.l is not None
        errors = self._pass("v", Work("v", None, ("errors",), x.get("s")))["errors"]
        alpha = self.priors.alpha + errors[0] / 2
        beta = self.priors.beta + errors[6] / 2
        tau = gamma_expectation(alpha, beta) if gibbs else gamma_mode(alpha, beta)
        for it in range(iterations):
            keep = bool(gibbs and self.thinned and it >= self.thinned[0] and (it - self.thinned[0]) % self.thinned[1] == 0)
            for no, name in enumerate(("u", "v")):
                wanted = ("middle",) if tri and name == "u" else ("errors",) if name == "v" else ()
                work = Work(name, self.method, wanted, x.get("s"), rate=self.rates[name], tau=tau, least=self.least, key=(self.seed, it, no), kept=keep)
                sums = self._pass(name, work)
                if tri and name == "u":
                    self._middle(x, np.full(x["s"].shape, float(self.rates["s"])), sums, tau)
            beta = self.priors.beta + sums["errors"][6] / 2
            tau = gamma_draw(alpha, beta, self.rng) if gibbs else gamma_mode(alpha, beta)
            x["tau"] = float(tau)
            if keep:
                self.kept += 1
                if tri:
                    x["s_kept"] = x.get("s_kept", 0) + x["s"]
            yield sums["errors"]

    def _vb_table(self, x, iterations):
        tri = self.l is not None
        var, mu, precision = {}, {}, {}
        if tri:
            mu["s"], precision["s"] = x["s"].copy(), np.full(x["s"].shape, float(self.tau_init))
            x["s"], var["s"] = tn_moments(mu["s"], precision["s"])
        wanted = ("expected", "errors", *(("middle_vb",) if tri else ()))
        sums = self._pass("v", Work("v", None, wanted, x.get("s"), var.get("s")))
        n = int(sums["errors"][0])
        alpha = self.priors.alpha + n / 2
        beta = self.priors.beta + sums["expected"] / 2
        for _ in range(iterations):
            tau, bounds = alpha / beta, 0.0
            if tri:
                self._middle_vb(x, var, mu, precision, np.full(x["s"].shape, float(self.rates["s"])), sums, tau)
            for name in ("u", "v"):
                order = self.rng.permutation(self.width[name]) if tri else None
                sums = self._pass(name, Work(name, "vb", ("bound",) if name == "u" else ("bound", *wanted), x.get("s"), var.get("s"), rate=self.rates[name], tau=tau, order=order))
                bounds += sums["bound"]
            beta = self.priors.beta + sums["expected"] / 2
            if tri:
                bounds += self.factor_bound(np.full(x["s"].shape, float(self.rates["s"])), x["s"], var["s"], mu["s"], precision["s"])
            x["tau"], x["log_tau"] = gamma_expectation(alpha, beta), gamma_expectation_log(alpha, beta)
            x["elbo"] = self.noise_bound(n, sums["expected"], alpha, beta) + bounds
            yield sums["errors"]

