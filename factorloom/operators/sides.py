"""Where row-local updates run: in this process on one block, or on executors over packed rows of a DataFrame.

Both sides offer run(fn, *shared): fn(block, *shared) is called on blocks of rows; per-row results come back in row
order, sums (dicts or 0/1-dimensional arrays) are added up. A model is written once against this interface.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Block

#: Bytes of factors that may be broadcast in one sweep, rows packed into one block, and cells that a task packs.
BROADCAST_BYTES, BLOCK_ROWS, TASK_CELLS = 1 << 29, 512, 1 << 19


def add(a, b):
    if a is None:
        return b
    return {k: a[k] + b[k] for k in a} if isinstance(a, dict) else a + b


class LocalSide:
    """All rows in one block of this process, which may hold test cells beside those that it trains on."""

    whole = True

    def __init__(self, block: Block):
        self.block, self.n = block, len(block.ids)

    def rows(self, fn, *shared) -> np.ndarray:
        return fn(self.block, *shared)

    def sums(self, fn, *shared):
        return fn(self.block, *shared)


def pack(obs: DataFrame, by: str, other: str, value: str = "r", tag: str | None = None, cells: int | None = None) -> DataFrame:
    """Cells gathered by row: idx, others (array, ascending), vals, and with a tag column tags. One shuffle on the row key;
    cells: their number, if known, by which tasks are made neither many and empty nor large."""
    tags = [F.col(tag).cast("int").alias("t")] if tag else []
    if cells is not None:
        least = obs.sparkSession.sparkContext.defaultParallelism
        obs = obs.withColumn(by, F.col(by).cast("bigint")).repartition(max(least, -(-cells // TASK_CELLS)), by)
    gathered = F.sort_array(F.collect_list(F.struct(F.col(other).cast("int").alias("o"), F.col(value).cast("double").alias("v"), *tags)))
    lists = [F.col(f"c.{f}").alias(name) for f, name in (("o", "others"), ("v", "vals"), ("t", "tags"))[: 2 + len(tags)]]
    return obs.groupBy(F.col(by).cast("bigint").alias("idx")).agg(gathered.alias("c")).select("idx", *lists)


def slices(batches):
    """(ids, counts, columns, values, tags or None) of packed rows, BLOCK_ROWS at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            lists = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(1, b.num_columns)]
            counts = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(), counts, lists[0].astype(np.int64), lists[1], lists[2] if len(lists) > 2 else None


class SparkSide:
    """Packed rows on executors; factors are broadcast once a sweep, nothing is shuffled between sweeps.

    fold: where rows carry tags, the cells of this tag are tested and not trained on."""

    whole = False

    def __init__(self, packed: DataFrame, n: int, keep: bool = True, fold: int | None = None):
        # Spark recomputes lost partitions of this cache from the packed rows' shuffle. A side that is read once need not be kept.
        self.packed, self.n, self.fold = packed.persist() if keep else packed, n, fold

    def close(self) -> None:
        self.packed.unpersist()

    @staticmethod
    def _bounded(shared) -> None:
        size = sum(x.nbytes for x in shared if isinstance(x, np.ndarray))
        if size > BROADCAST_BYTES:
            raise ValueError(f"factors of {size} bytes exceed the broadcast bound of {BROADCAST_BYTES}; fit them in blocks (blocked.py), lower the number of factors or raise sides.BROADCAST_BYTES")

    def _collect(self, fn, shared, summed: bool) -> list:
        """(ids, result) of each block, or with summed (first id, sum) of each task; all tasks run at once."""
        spark = self.packed.sparkSession
        self._bounded(shared)
        sent, fold = spark.sparkContext.broadcast(shared), self.fold

        def blocks(batches):
            for ids, counts, idx, val, tag in slices(batches):
                yield ids, fn(Block.parted(ids, counts, idx, val, None if fold is None else tag == fold), *sent.value)

        def packet(x):
            return pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(x)], pa.binary())], ["out"])

        def run(batches):
            first = total = None
            for ids, value in blocks(batches):
                if not summed:
                    yield packet((ids, value))
                elif len(ids):
                    first, total = int(ids[0]) if first is None else min(first, int(ids[0])), add(total, value)
            if first is not None:
                yield packet((first, total))

        try:
            return [pickle.loads(r.out) for r in self.packed.mapInArrow(run, "out binary").collect()]
        finally:
            sent.destroy()

    def rows(self, fn, *shared) -> np.ndarray:
        parts = self._collect(fn, shared, False)
        ids, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        out = np.zeros((self.n, *values.shape[1:]))
        out[ids] = values
        return out

    def sums(self, fn, *shared):
        total = None
        for _, value in sorted(self._collect(fn, shared, True), key=lambda p: p[0]):  # one order, so equal runs add alike
            total = add(total, value)
        return total

    def frame(self, fn, *shared) -> DataFrame:
        """Like rows(), but as a DataFrame idx, vec that stays on the executors."""
        self._bounded(shared)
        sent = self.packed.sparkSession.sparkContext.broadcast(shared)

        def run(batches):
            for ids, counts, idx, val, _ in slices(batches):
                x = np.asarray(fn(Block(ids, counts, idx, val), *sent.value), float)
                ends = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["idx", "vec"])

        return self.packed.mapInArrow(run, "idx bigint, vec array<double>")
