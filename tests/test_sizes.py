"""What larger tables and odd values showed: the whole job at any size, with the same results."""

import numpy as np
import pytest

from factorloom.operators import masks as M


def test_a_fraction_is_taken_as_written(spark):
    """0.7 of 90 cells are 63; the product of doubles is below."""
    obs = spark.createDataFrame([(k, 0, 1.0) for k in range(90)], "i long, j long, r double")
    assert M.split(obs, 90, 1, 0.3, 1).where("split = 'train'").count() == 63
    assert M.random_mask(spark, 10, 1, 0.9, 1).count() == 1
    sparse = spark.createDataFrame([(0, k, 1.0) for k in range(90)] + [(1, k, 1.0) for k in range(90)], "i long, j long, r double")
    assert M.covering_split(sparse, 180, 1, 0.3, 1).where("split = 'train'").count() == 126


def test_kmeans_ties_that_differ_by_rounding_go_to_the_first():
    """The sums of squares to both centres are equal, whatever the order of the cells makes of them."""
    from factorloom.operators.kernels import Block
    from factorloom.operators.kmeans import distances, nearest

    part = np.array([1 / 3, 2 / 3, 0.1, 0.7, 1.9, 2.3])
    r = np.concatenate((25 + part, 25 - part))  # each on one side has another on the other side
    centres = np.stack((np.full(len(r), 20.0), np.full(len(r), 30.0)))
    rounded = 0
    for seed in range(40):
        order = np.random.default_rng(seed).permutation(len(r))
        block = Block(np.array([0]), np.array([len(r)]), order, r[order])
        d = distances(block, centres, np.ones_like(centres))[0]
        rounded += d[1] < d[0]
        assert nearest(block, centres, np.ones_like(centres))[0, 0] == 0
    assert rounded


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quality_ic", "kmeans_fixed_point", "kmeans_fit"])
def test_cells_and_points_stay_on_executors(spark, name, monkeypatch):
    from factorloom.operators.kmeans import MaskedKMeans
    from factorloom.operators.models import Cells
    from factorloom.plans import registry

    def refuse(*a, **k):
        raise AssertionError("passed through the driver")

    for owner, method in ((Cells, "from_df"), (MaskedKMeans, "fit"), (MaskedKMeans, "fit_sides")):
        monkeypatch.setattr(owner, method, refuse)
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["vb_nmf_fit", "vb_nmtf_fit"])
def test_variational_factors_stay_on_executors(spark, name, monkeypatch):
    from factorloom.operators.sides import SparkSide
    from factorloom.plans import registry

    monkeypatch.setattr(SparkSide, "rows", None)
    found = [r.mse for r in registry.queries()[name](spark, SF).orderBy("iteration").collect()]
    assert len(found) == 3 and found[2] < found[0]


def test_folded_cells_are_made_once(spark):
    """However often a matrix of folds is read, what it is made of is evaluated once."""
    from factorloom.operators.batched import FoldedMatrix
    from factorloom.operators.tables import exists

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cells = spark.createDataFrame([(i, j, 1.0 + i * j) for i in range(20) for j in range(10)], "i long, j long, r double")
    matrix = FoldedMatrix(M.round_robin(cells, 2, 1).mapInArrow(count, "i long, j long, r double, fold int"), 20, 10)
    matrix.packed[0].count(), matrix.packed[1].count(), matrix.sizes().collect()
    assert seen.value == 200
    assert exists(spark, matrix.folded._written_at)
    matrix.close()
    assert not exists(spark, matrix.folded._written_at)


def test_blocks_follow_cells(spark, monkeypatch):
    """A few columns of very many rows do not lie in one block, and the fit is the same."""
    from factorloom.operators import blocked, kernels
    from factorloom.operators.models import Factorizer, Priors
    from factorloom.sources.synthetic import local_toy

    toy = local_toy(60, 6, 2, fraction=0.4, seed=4)[0]
    obs = spark.createDataFrame([(int(i), int(j), float(r)) for i, j, r in zip(toy.i, toy.j, toy.r)], "i long, j long, r double")
    want = Factorizer("icm", 2, None, Priors()).fit(*toy.sides(), 2)
    monkeypatch.setattr(blocked, "BLOCK_CELLS", 40)
    monkeypatch.setattr(kernels, "PART_CELLS", 7)
    most, blocks = [], blocked.BlockedSide.__init__

    def kept(self, *a):
        blocks(self, *a)
        most.append(max(len(r.vals) // 8 for r in self.table.collect()))

    monkeypatch.setattr(blocked.BlockedSide, "__init__", kept)
    got = blocked.BlockedFactorizer("icm", 2, None, Priors()).fit_table(obs, 60, 6, 2)
    assert max(most) < 80
    assert got.history[-1]["MSE"] == pytest.approx(want.history[-1]["MSE"], rel=1e-9)
    assert np.allclose(np.array([r.vec for r in got.v.orderBy("idx").collect()]), want.v, rtol=1e-7)


@pytest.mark.parametrize("method, l", [("np", 2), ("icm", 2), ("gibbs", None), ("vb", 2)])
def test_cells_of_a_column_lie_in_parts(spark, method, l, monkeypatch):
    """A column of more cells than a task takes, beside a row that has most cells: the fit is the same."""
    from factorloom.operators import blocked, kernels
    from factorloom.operators.models import Cells, Factorizer, Priors

    rng = np.random.default_rng(4)
    seen = rng.random((60, 12)) < 0.15
    seen[:, :2] = seen[7] = True
    seen[np.arange(60), np.arange(60) % 12] = True
    toy = Cells.dense(rng.random((60, 12)) + 0.1, seen)
    obs = spark.createDataFrame([(int(i), int(j), float(r)) for i, j, r in zip(toy.i, toy.j, toy.r)], "i long, j long, r double")
    settings = dict(k=2, l=l, priors=Priors(rows=1.0, columns=0.5, middle=2.0), init="ones" if method == "np" else "exp", seed=3, joint=True)
    want = Factorizer(method, **settings).fit(*toy.sides(), 1)
    monkeypatch.setattr(blocked, "BLOCK_CELLS", 30)
    monkeypatch.setattr(kernels, "PART_CELLS", 7)
    most, blocks = [], blocked.BlockedSide.__init__

    def kept(self, *a):
        blocks(self, *a)
        most.append(max(len(r.vals) // 8 for r in self.table.collect()))

    monkeypatch.setattr(blocked.BlockedSide, "__init__", kept)
    got = blocked.BlockedFactorizer(method, **settings).fit_table(obs, 60, 12, 1)
    assert max(most) <= 40  # 60 in the longest column
    for a, b in zip(got.history, want.history, strict=True):
        for m in ("MSE", "R^2", "i_div", "elbo"):
            assert a[m] == pytest.approx(b[m], rel=1e-8)
    assert np.allclose(np.array([r.vec for r in got.u.orderBy("idx").collect()]), want.u, rtol=1e-7)
    assert np.allclose(np.array([r.vec for r in got.v.orderBy("idx").collect()]), want.v, rtol=1e-7)


@pytest.mark.parametrize("method, l", [("icm", None), ("np", 2)])
def test_passes_hold_a_part_of_a_long_column(spark, method, l, monkeypatch):
    """The cells and the other side's rows that Python holds at once are a part's, in every pass; the fit is the same."""
    import pickle

    from factorloom.operators import blocked
    from factorloom.operators.models import Cells, Factorizer, Priors
    from factorloom.operators.tables import deleted

    most, half = [], blocked.BlockedSide.half

    def kept(self, *given):
        held = half(self, *given[:-1], lambda block, own, other: (None, (len(block.val), len(other))))
        most.extend(max(pickle.loads(r.sums)) for r in held.collect())
        deleted(held)
        return half(self, *given)

    monkeypatch.setattr(blocked, "BLOCK_CELLS", 40)
    monkeypatch.setattr(blocked.BlockedSide, "half", kept)
    settings = dict(k=2, l=l, priors=Priors(), init="ones" if method == "np" else "exp", seed=3, joint=True)
    toy = Cells.dense(np.random.default_rng(4).random((240, 3)) + 0.1, np.ones((240, 3), bool))
    obs = spark.createDataFrame([(int(i), int(j), float(r)) for i, j, r in zip(toy.i, toy.j, toy.r)], "i long, j long, r double")
    want = Factorizer(method, **settings).fit(*toy.sides(), 1)
    got = blocked.BlockedFactorizer(method, **settings).fit_table(obs, 240, 3, 1)
    assert max(most) <= 40  # 240 in a column
    assert got.history[-1]["MSE"] == pytest.approx(want.history[-1]["MSE"], rel=1e-8)


def test_kernels_are_made_in_trials(spark):
    """The driver holds no kernel; likeness needs one matrix of rows by rows, not rows by rows by columns."""
    import tracemalloc

    from factorloom.operators.kernelized import FilledLikeness, KernelSetup, cross_validate, likeness
    from factorloom.operators.models import Cells

    x = np.random.default_rng(1).random((30, 8)) * 9
    want = np.exp(-((x[:, None] - x[None]) ** 2).mean(2) / 50)
    assert np.allclose(likeness(x, 50.0), want, rtol=1e-12)
    tracemalloc.start()
    likeness(np.tile(x, (20, 3)), 50.0)
    assert tracemalloc.get_traced_memory()[1] < 3 * 600 * 600 * 8
    tracemalloc.stop()
    cells = Cells.dense(x, np.random.default_rng(2).random(x.shape) < 0.8)
    filled = np.full(x.shape, cells.r.mean())
    filled[cells.i, cells.j] = cells.r
    given = cross_validate(spark, [likeness(filled, 50.0)], [likeness(filled.T, 50.0)], cells, KernelSetup(iterations=3), [1, 2], 2)
    made = cross_validate(spark, FilledLikeness(False), FilledLikeness(True), cells, KernelSetup(iterations=3), [1, 2], 2)
    for k, v in given[0].items():
        assert made[0][k]["MSE"] == pytest.approx(v["MSE"], rel=1e-9)


def test_a_relation_is_dealt_by_its_rows(spark, monkeypatch):
    """However few partitions a shuffle has otherwise, one reads no more of a larger table."""
    from pyspark.sql import functions as F

    from factorloom.operators import tables
    from factorloom.plans import relations

    most, write = [], tables.written

    def kept(df, *a):
        out = write(df, *a)
        most.append(out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(tables, "TASK_ROWS", 300, raising=False)
    monkeypatch.setattr(relations, "written", kept)
    monkeypatch.setattr(relations, "_WRITTEN", {})
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        cells = relations.observed(spark, SF)[0].count()
    finally:
        spark.conf.unset(coalesce)
    assert most[0] < cells / 8  # 20 partitions; the session's 4 held a quarter each
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_trials_hold_little_of_a_cell(spark, monkeypatch):
    """Numbers of cells and folds are sent as small as they are, few trials run at once on a large matrix, results are equal."""
    from factorloom.operators import trials
    from factorloom.operators.trials import Setup, greedy_search_cv
    from factorloom.sources.synthetic import local_toy

    toy, seen, run = local_toy(30, 8, 2, fraction=0.2, seed=4)[0], [], trials.run_trials

    def kept(spark, shared, todo, work, at_a_time=None):
        seen.append((sum(x.nbytes for x in (shared[1].i, shared[1].j, shared[2])), at_a_time))
        return run(spark, shared, todo, work, at_a_time)

    setup = Setup("vb", iterations=3, init="random", seed=1)
    fold = trials.fold_numbers(toy, 2, 1)
    trial = trials._trial(setup, 2, 2, 0, fold=0)
    want = trials._fit_trial((setup, toy, fold), trial)
    monkeypatch.setattr(trials, "run_trials", kept)
    monkeypatch.setattr(trials, "TRIAL_BYTES", 110 * 2 * len(toy.r), raising=False)
    assert trials.runner(spark, toy, fold)(setup, [trial])[0] == trial | want
    assert greedy_search_cv(spark, toy, setup, [1, 2], [1, 2], 2).average["MSE"] > 0
    assert all(size <= 4 * len(toy.r) and n == 2 for size, n in seen)
