"""Matrices made of the test tables: average quantity by customer and brand (cb), supplier and brand (sb), supplier and part (sp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masks import dense_index
from ..operators.tables import deleted, exists, written

KEYS = {"cb": ("o_custkey", "p_brand"), "sb": ("l_suppkey", "p_brand"), "sp": ("l_suppkey", "l_partkey")}


def cells(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """a, b, r: the keys and the average quantity."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    a, b = KEYS[kind]
    lines = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    if kind == "cb":
        lines = lines.join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if kind != "sp":
        lines = lines.join(read("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.avg("l_quantity").alias("r"))


#: Relations that this application has written: by application, folder and kind, the path and the numbers of rows and columns.
_WRITTEN: dict[tuple[str, str, str], tuple[str, int, int]] = {}


def observed(spark: SparkSession, sf_dir: str, kind: str = "cb") -> tuple[DataFrame, int, int]:
    """obs(i, j, r), the number of rows and of columns. The relation is written when it is first asked for, so that the joins
    behind it are made once and no query holds a cache."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key][0]):
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        c = written(cells(spark, sf_dir, kind), lines)
        n = c.agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).first()
        rows, columns = dense_index(c, "a", "i"), dense_index(c, "b", "j")
        obs = written(c.join(rows, "a").join(columns, "b").select("i", "j", "r"), lines)
        deleted(c)
        _WRITTEN[key] = (obs._written_at, n.a, n.b)
    path, n_a, n_b = _WRITTEN[key]
    return spark.read.schema("i bigint, j bigint, r double").parquet(path), n_a, n_b


def obs_sql(kind: str = "cb") -> str:
    """The same relation in SQL: tables obs(i, j, r) and meta(n_i, n_j, n)."""
    a, b = KEYS[kind]
    joins = "JOIN orders ON l_orderkey = o_orderkey " * (kind == "cb") + "JOIN part ON l_partkey = p_partkey " * (kind != "sp")
    return f"""WITH cells AS (SELECT {a} AS a, {b} AS b, avg(l_quantity) AS r FROM lineitem {joins}GROUP BY 1, 2),
rk AS (SELECT a, row_number() OVER (ORDER BY md5(CAST(a AS VARCHAR)), a) - 1 AS i FROM (SELECT DISTINCT a FROM cells)),
ck AS (SELECT b, row_number() OVER (ORDER BY md5(CAST(b AS VARCHAR)), b) - 1 AS j FROM (SELECT DISTINCT b FROM cells)),
obs AS (SELECT i, j, r FROM cells JOIN rk USING (a) JOIN ck USING (b)),
meta AS (SELECT (SELECT count(*) FROM rk) AS n_i, (SELECT count(*) FROM ck) AS n_j, (SELECT count(*) FROM obs) AS n)"""
