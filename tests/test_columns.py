import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import columns as C
from factorloom.functions.special import tn_moments


def drawn(spark, n, column):
    rows = spark.range(n).withColumn("x", column)
    again = sorted((r.id, r.x) for r in rows.repartition(5).collect())
    assert again == sorted((r.id, r.x) for r in rows.collect())  # under any partitioning
    return np.array([x for _, x in again])


@pytest.mark.parametrize("mu, tau", [(1.0, 2.0), (-3.0, 1.0), (0.0, 4.0), (-20.0, 0.5)])
def test_normal_above_zero(spark, mu, tau):
    x = drawn(spark, 30_000, C.normal_above_zero(F.lit(mu), F.lit(tau), 1, ["id"]))
    mean, var = tn_moments(mu, tau)
    assert (x >= 0).all() and abs(x.mean() - mean) < 5 * math.sqrt(var / len(x)) and abs(x.var() - var) < 0.08 * var


@pytest.mark.parametrize("alpha, beta", [(3.0, 2.0), (0.4, 1.0), (50.0, 0.1)])
def test_gamma(spark, alpha, beta):
    x = drawn(spark, 30_000, C.gamma(F.lit(alpha), F.lit(beta), 1, ["id"], 7))
    assert abs(x.mean() - alpha / beta) < 5 * math.sqrt(alpha / beta**2 / len(x)) and abs(x.var() - alpha / beta**2) < 0.1 * alpha / beta**2


def test_others_and_cases(spark):
    x = drawn(spark, 30_000, C.exponential(F.lit(4.0), 1, ["id"]))
    assert abs(x.mean() - 0.25) < 0.01
    x = drawn(spark, 30_000, C.normal(F.lit(2.0), F.lit(0.25), 1, ["id"]))
    assert abs(x.mean() - 2) < 0.06 and abs(x.std() - 2) < 0.05
    rows = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, -1.0), (3, None, 1.0), (4, float("inf"), 1.0), (None, 1.0, 1.0), (5, 1.0, float("inf"))], "id long, mu double, tau double")
    mu, tau = F.col("mu"), F.col("tau")
    out = rows.select("id", C.normal_above_zero(mu, tau, 1, ["id"]).alias("t"), C.normal(mu, tau, 1, ["id"]).alias("n"), C.exponential(tau, 1, ["id"]).alias("e"), C.gamma(mu, tau, 1, ["id"]).alias("g"))
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (0.0, None, None, None) and got[2] == (0.0, None, None, None) and got[3][0] is None and got[3][1] is None
    assert got[4][0] == 0.0 and got[4][3] is None and got[5] == (0.0, None, None, None)
    assert all(x is not None for x in got[None])
