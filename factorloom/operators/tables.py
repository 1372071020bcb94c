"""Tables that loops write in place of a growing plan: in the folder that spark.checkpoint.dir names, deleted once read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ADVISORY, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"
#: Rows of a table's source for each partition of a shuffle behind it.
PARTITIONS, TASK_ROWS = "spark.sql.shuffle.partitions", 1 << 18
#: Bytes of files that a task reads of such a source: it holds what it deals out.
SPLIT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own for a local session, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, rows: int = 0) -> DataFrame:
    """df, written and read again. Tasks that join or group for it read TASK_BYTES of a shuffle: what they sort or hold is some
    ten times that. rows: those that it is made of, if known; Spark puts small partitions of a shuffle together but splits none,
    so there is one for each TASK_ROWS of them, and a task reads no more of a larger table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    old = {k: spark.conf.get(k) for k in (ADVISORY, PARTITIONS, SPLIT)}
    spark.conf.set(ADVISORY, TASK_BYTES)
    if rows:
        spark.conf.set(PARTITIONS, str(max(int(old[PARTITIONS]), -(-rows // TASK_ROWS))))
        spark.conf.set(SPLIT, SPLIT_BYTES)
    try:
        df.write.parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def deleted(*frames: DataFrame) -> None:
    """Delete what written() wrote for these frames."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
