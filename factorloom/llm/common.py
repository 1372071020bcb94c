"""What the corpus operators share: tables in the shared folder, fresh column names, components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own on a single machine (tests); on a
    cluster, an error: a folder of the driver's machine would not be seen by the executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and a lost executor costs no recomputation."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # The written files replace the shuffle files behind them; without this those stay until the driver happens to
    # collect its garbage, and long operators pile them up.
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df: DataFrame, text_col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def sample_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those whose keys hash lowest, in that order.

    Rows beyond a cut of twice the share wanted are left out where they stand, so that what tasks send for the last
    choice is bounded in all, not for each task."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    n = rows.select(key).count()
    cut = min(1 << 40, (1 << 40) * 2 * most // max(n, 1) + 1)
    return rows.where(h < cut).orderBy(h, *rows.columns).limit(most)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v) of any one orderable type: node, root (the smallest node reachable).

    Large-star and small-star steps, each an aggregation with map-side combine and a join, merged so that no table of nodes
    is gathered by the driver for a broadcast. Both sides of a join are
    written tables, so that Spark can split the partition of a hub of any degree. No edges: an empty table.
    """
    kind = edges.schema[0].dataType
    now = materialize(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Done when each node points to one other, and none points to a node that points on.
        n, nodes = now.agg(F.count("*"), F.countDistinct("u")).first()
        if n == nodes and now.join(now.select(F.col("v").alias("u")).hint("merge"), "u", "left_semi").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(first.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(spark, large.where("u <> v").distinct())
        least = materialize(spark, large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = materialize(spark, small.where("u <> v").distinct())
        forget(spark, now, first, large, least)
        now = new
    out = now.groupBy("u").agg(F.min("v").alias("m"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return out.select(F.col("u").alias("node"), F.col("m").alias("root")).union(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))
