"""Errors of predictions: from moments of cells, and as one aggregation of a DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_sums(s) -> dict[str, float]:
    """MSE, R^2 (inf without variance of the truth), Rp (nan without variance of either) from kernels.Moments."""
    if not s.n:
        return {"MSE": math.nan, "R^2": math.nan, "Rp": math.nan}
    # A spread of a millionth of a millionth of the mean is rounding.
    flat, level = (x <= 1e-24 * s.n * mean * mean for x, mean in ((s.rr, s.mean_r), (s.pp, s.mean_p)))
    return {"MSE": s.se / s.n, "R^2": math.inf if flat else 1 - s.se / s.rr, "Rp": math.nan if flat or level else s.rp / math.sqrt(s.rr * s.pp)}


def global_metrics(pairs: DataFrame, truth: str = "r", predicted: str = "p") -> DataFrame:
    """One row: n, mse, r2, rp of truth against predicted, over the pairs that have both (NaN is a value). One pass: variances
    and the covariance are aggregated by centred moments, so that large means do no harm."""
    r, p = F.col(truth), F.col(predicted)
    both = pairs.where(r.isNotNull() & p.isNotNull())
    s = both.agg(F.count("*").alias("n"), F.avg((r - p) ** 2).alias("mse"), F.var_pop(r).alias("rr"), F.var_pop(p).alias("pp"), F.covar_pop(r, p).alias("rp"), F.avg(r).alias("mr"), F.avg(p).alias("mp"))
    flat: Column = F.col("rr") <= 1e-24 * F.col("mr") * F.col("mr")
    level = F.col("pp") <= 1e-24 * F.col("mp") * F.col("mp")
    return s.select("n", "mse", F.when(flat, F.lit(math.inf)).otherwise(1 - F.try_divide("mse", "rr")).alias("r2"), F.when(flat | level, F.lit(math.nan)).otherwise(F.try_divide("rp", F.sqrt(F.col("rr") * F.col("pp")))).alias("rp"))


def i_divergence(pairs: DataFrame, truth: str = "r", predicted: str = "p") -> DataFrame:
    r, p = F.col(truth), F.col(predicted)
    return pairs.where(r.isNotNull() & p.isNotNull()).agg(F.sum(F.when(r > 0, r * F.ln(F.try_divide(r, p)) - r + p).otherwise(p)).alias("i_div"))
