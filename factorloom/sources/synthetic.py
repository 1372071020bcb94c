"""Synthetic matrices: exponential factors, normal noise, masks, and the sweeps over missing fractions and noise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masks import grid, try_mask
from ..operators.models import Cells


def _factor(spark: SparkSession, n: int, k: int, rate: float, seed: int, name: str) -> DataFrame:
    """n rows of k exponential draws that depend on (seed, name, row, k) only, whatever the partitions."""
    uniform = lambda c: (F.abs(F.xxhash64(F.lit(seed), F.lit(name), F.col("idx"), F.lit(c)) % (1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return spark.range(n).select(F.col("id").alias("idx")).withColumn("vec", F.array(*(-F.log(uniform(c)) / rate for c in range(k))))


def _normal(seed: int):
    u = lambda name: (F.abs(F.xxhash64(F.lit(seed), F.lit(name), F.col("i"), F.col("j")) % (1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))


def generate_nmf(spark: SparkSession, rows: int, columns: int, k: int, rate_u: float = 1.0, rate_v: float = 1.0, tau: float = 1.0, seed: int = 0):
    """U, V (idx, vec) and R (i, j, true_r, r)."""
    u, v = _factor(spark, rows, k, rate_u, seed, "u"), _factor(spark, columns, k, rate_v, seed, "v")
    return u, v, _observe(spark, u, v, rows, columns, tau, seed)


def generate_nmtf(spark: SparkSession, rows: int, columns: int, k: int, l: int, rate_f: float = 1.0, rate_s: float = 1.0, rate_g: float = 1.0, tau: float = 1.0, seed: int = 0):
    """F, S, G and R; S is a k x l array."""
    f, g = _factor(spark, rows, k, rate_f, seed, "f"), _factor(spark, columns, l, rate_g, seed, "g")
    s = np.random.default_rng([seed, 3]).exponential(1 / rate_s, (k, l))
    across = F.array(*(F.aggregate(F.zip_with("vec", F.array(*map(F.lit, s[:, c].tolist())), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b) for c in range(l)))
    return f, s, g, _observe(spark, f.select("idx", across.alias("vec")), g, rows, columns, tau, seed)


def _observe(spark, left: DataFrame, right: DataFrame, rows: int, columns: int, tau: float, seed: int) -> DataFrame:
    cells = grid(spark, rows, columns).join(left.select(F.col("idx").alias("i"), F.col("vec").alias("a")), "i").join(right.select(F.col("idx").alias("j"), F.col("vec").alias("b")), "j")
    true = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return add_noise(cells.select("i", "j", true.alias("true_r")), tau, seed)


def add_noise(cells: DataFrame, tau: float, seed: int) -> DataFrame:
    """r = true_r plus normal noise of precision tau; an infinite precision adds none."""
    return cells.withColumn("r", F.col("true_r") if math.isinf(tau) else F.col("true_r") + _normal(seed) / math.sqrt(tau))


def noise_precision(cells: DataFrame, ratio: float) -> float:
    """The precision whose noise has that share of the true values' variance."""
    return math.inf if ratio == 0 else 1 / (cells.agg(F.var_pop("true_r")).first()[0] * ratio)


def toy(spark: SparkSession, tri: bool = False, fraction: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The standard toy: 100 x 80, K = 10 or K = L = 5, a tenth unobserved. All cells, and the observed ones."""
    cells = generate_nmtf(spark, 100, 80, 5, 5, seed=seed)[3] if tri else generate_nmf(spark, 100, 80, 10, seed=seed)[2]
    return cells, cells.join(try_mask(spark, 100, 80, fraction, 100, seed), ["i", "j"])


def local_toy(rows: int = 100, columns: int = 80, k: int = 10, l: int | None = None, tau: float = 1.0, fraction: float = 0.1, seed: int = 0) -> tuple[Cells, Cells]:
    """Observed and left-out cells of one synthetic matrix, for trials in this process."""
    rng = np.random.default_rng([seed, 5])
    left = rng.exponential(1.0, (rows, k))
    if l is not None:
        left = left @ rng.exponential(1.0, (k, l))
    r = left @ rng.exponential(1.0, (columns, l or k)).T
    r = r if math.isinf(tau) else r + rng.normal(0, 1 / math.sqrt(tau), r.shape)
    for _ in range(1000):
        hidden = np.zeros(rows * columns, bool)
        hidden[rng.permutation(rows * columns)[: int(rows * columns * fraction)]] = True
        mask = ~hidden.reshape(rows, columns)
        if mask.any(0).all() and mask.any(1).all():
            return Cells.dense(r, mask), Cells.dense(r, ~mask)
    raise ValueError("Tried to generate a mask that covers all rows and columns, with 1000 attempts, but failed.")
