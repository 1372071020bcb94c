"""Covering splits and folds of a sparse matrix (supplier by part), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as M
from .registry import FOLDS, FRACTION, SEED, query, r6
from .relations import obs_sql, observed

_KEY = f"md5('{SEED}|' || CAST(i AS VARCHAR) || '|' || CAST(j AS VARCHAR))"
_COVER = f"""{obs_sql('sp')}, keyed AS (SELECT i, j, r, {_KEY} AS k FROM obs),
cover AS (SELECT i, arg_min(j, k) AS j FROM keyed GROUP BY i UNION SELECT arg_min(i, k), j FROM keyed GROUP BY j),
rest AS (SELECT i, j, r, row_number() OVER (ORDER BY k, i, j) - 1 AS p FROM keyed ANTI JOIN cover USING (i, j)),
held AS (SELECT count(*) AS c FROM cover)"""


@query(f"{_COVER} SELECT i, j FROM cover")
def cover_cells(spark, sf_dir):
    return M.cover(observed(spark, sf_dir, "sp")[0], SEED)


@query(f"{_COVER} SELECT i, j, CAST(((p + 1) * {FOLDS} - 1) // (SELECT count(*) FROM rest) AS INTEGER) AS fold FROM rest UNION ALL SELECT i, j, -1 FROM cover")
def covering_folds(spark, sf_dir):
    """Folds of which every training part covers all suppliers and parts."""
    return M.covering_folds(observed(spark, sf_dir, "sp")[0], FOLDS, SEED).select("i", "j", "fold")


@query(f"""{_COVER}, room AS (SELECT CAST(floor(n * (1 - {FRACTION})) AS BIGINT) AS n_train FROM meta)
SELECT i, j, round(r, 6) AS r, CASE WHEN p < n_train - c THEN 'train' ELSE 'test' END AS split FROM rest, held, room
UNION ALL SELECT i, j, round(r, 6), 'train' FROM obs JOIN cover USING (i, j)""")
def covering_split(spark, sf_dir):
    """A fraction of the cells held is tested: the matrix is sparse, so the fraction is taken of them."""
    obs, _, _ = observed(spark, sf_dir, "sp")
    return M.covering_split(obs, obs.count(), 1, FRACTION, SEED).select("i", "j", r6("r").alias("r"), "split")


@query(f"""WITH lines AS (SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n, (SELECT count(DISTINCT p_brand) FROM part) AS m),
g AS (SELECT i, j, {_KEY} AS k FROM (SELECT unnest(range(n)) AS i, m FROM lines) CROSS JOIN (SELECT unnest(range(m)) AS j FROM lines)),
cover AS (SELECT i, arg_min(j, k) AS j FROM g GROUP BY i UNION SELECT arg_min(i, k), j FROM g GROUP BY j),
rest AS (SELECT i, j, row_number() OVER (ORDER BY k, i, j) - 1 AS p FROM g ANTI JOIN cover USING (i, j))
SELECT i, j FROM rest, lines WHERE p < n * m - CAST(floor(n * m * 0.8) AS BIGINT) - (SELECT count(*) FROM cover) UNION ALL SELECT i, j FROM cover""")
def covering_mask(spark, sf_dir):
    """Four fifths of the pairs of suppliers and brands are taken out, and none of either is left alone."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct().count()
    m = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().count()
    return M.covering_mask(spark, n, m, 0.8, SEED).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
