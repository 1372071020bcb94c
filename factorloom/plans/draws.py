"""Draws for the rows of a table, and the same draws in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from .registry import SEED, query

_U = "(CAST('0x' || substr({h}, {at}, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_FIRST, _SECOND = _U.format(h="h", at=1), _U.format(h="h", at=14)
_NORMAL = f"sqrt(-2 * ln({_FIRST})) * cos(2 * {math.pi!r} * {_SECOND})"
#: The rows with the parameters of their draws.
_ROWS = "rows AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey AS a, l_linenumber AS b, (l_quantity - 30) / 10 AS mu, CAST(1 + l_linenumber AS DOUBLE) / 2 AS tau, 0.4 + l_quantity / 20 AS shape FROM lineitem)"


def _digest(count: str) -> str:
    return f"md5('{SEED}|' || CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR) || '|' || {count})"


def _rows(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), ((F.col("l_quantity") - 30) / 10).alias("mu"), ((1 + F.col("l_linenumber")).cast("double") / 2).alias("tau"), (0.4 + F.col("l_quantity") / 20).alias("shape"))


def _moments(df, name: str):
    x = F.col(name)
    return df.groupBy("b").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.avg(x * x), 5).alias("square"), F.round(F.min(x), 6).alias("least"), F.round(F.max(x), 6).alias("greatest")).withColumnRenamed("b", "line")


_OUT = "SELECT b AS line, count(x) AS n, round(avg(x), 6) AS mean, round(avg(x * x), 5) AS square, round(min(x), 6) AS least, round(max(x), 6) AS greatest FROM drawn GROUP BY b"


@query(f"WITH {_ROWS}, digests AS (SELECT *, {_digest(chr(39) + '0' + chr(39))} AS h FROM rows), drawn AS (SELECT b, -ln({_FIRST}) / tau AS x FROM digests) {_OUT}")
def exponential_draws(spark, sf_dir):
    return _moments(_rows(spark, sf_dir).withColumn("x", C.exponential(F.col("tau"), SEED, ["a", "b"])), "x")


@query(f"WITH {_ROWS}, digests AS (SELECT *, {_digest(chr(39) + '0' + chr(39))} AS h FROM rows), drawn AS (SELECT b, mu + {_NORMAL} / sqrt(tau) AS x FROM digests) {_OUT}")
def normal_draws(spark, sf_dir):
    return _moments(_rows(spark, sf_dir).withColumn("x", C.normal(F.col("mu"), F.col("tau"), SEED, ["a", "b"])), "x")


#: All attempts of each row; the first that is accepted counts.
_TRIES = f"tries AS (SELECT *, {_digest(chr(39) + '0.' + chr(39) + ' || CAST(k AS VARCHAR)')} AS h FROM rows, range(0, 24) t(k))"


@query(f"""WITH {_ROWS}, {_TRIES}, proposed AS (SELECT id, b, mu, tau, k, -mu * sqrt(tau) AS low, (-mu * sqrt(tau) + sqrt(mu * mu * tau + 4)) / 2 AS rate, {_FIRST} AS u, {_SECOND} AS w, {_NORMAL} AS middle FROM tries),
judged AS (SELECT *, low - ln(u) / rate AS tail FROM proposed), kept AS (SELECT id, b, mu, tau, k, CASE WHEN low > 0 THEN tail ELSE middle END AS z FROM judged WHERE CASE WHEN low > 0 THEN w <= exp(-0.5 * (tail - rate) * (tail - rate)) ELSE middle >= low END),
drawn AS (SELECT b, greatest(mu + arg_min(z, k) / sqrt(tau), 0) AS x FROM kept GROUP BY id, b, mu, tau) {_OUT}""")
def normal_above_zero_draws(spark, sf_dir):
    return _moments(_rows(spark, sf_dir).withColumn("x", C.normal_above_zero(F.col("mu"), F.col("tau"), SEED, ["a", "b"])), "x")


_D = "(CASE WHEN shape < 1 THEN shape + 1 ELSE shape END - 1 / 3.0::DOUBLE)"


@query(f"""WITH {_ROWS}, {_TRIES}, proposed AS (SELECT id, a, b, tau, shape, k, {_D} AS d, {_NORMAL} AS z, {_U.format(h='md5(h)', at=1)} AS u FROM tries),
judged AS (SELECT *, (1 + z / sqrt(9 * d)) ** 3 AS v FROM proposed), kept AS (SELECT id, a, b, tau, shape, k, d * v AS g FROM judged WHERE v > 0 AND ln(u) < 0.5 * z * z + d - d * v + d * ln(CASE WHEN v > 0 THEN v END)),
firsts AS (SELECT id, a, b, tau, shape, arg_min(g, k) AS g FROM kept GROUP BY id, a, b, tau, shape), ends AS (SELECT *, {_digest(chr(39) + '1' + chr(39))} AS h FROM firsts),
drawn AS (SELECT b, g * CASE WHEN shape < 1 THEN ({_FIRST}) ** (1 / shape) ELSE 1 END / tau AS x FROM ends) {_OUT}""")
def gamma_draws(spark, sf_dir):
    return _moments(_rows(spark, sf_dir).withColumn("x", C.gamma(F.col("shape"), F.col("tau"), SEED, ["a", "b"])), "x")
