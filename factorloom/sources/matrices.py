"""Sources and sinks of observed matrices: delimited tables with row labels, whitespace text, features, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("cell_line", "cancer_type", "tissue")


def _numbered(lines: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
    """Lines read from files, numbered from 0 in the order of files and lines; only those that keep holds for.

    A block of a file is read by one task in its order, so a line's number is its place among the block's lines and
    the lines of the blocks before: one count for each block, no window over all lines."""
    lines = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    if keep is not None:
        lines = lines.where(keep)
    ranked = lines.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n")).select("_file", "_block", before.alias("_before"))  # a row for each block
    return ranked.join(blocks, ["_file", "_block"]).withColumn(name, (F.col("_place") + F.col("_before")).cast("bigint")).drop("_file", "_block", "_at", "_place", "_before")


def read_sensitivity(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A table with a header, three label columns and a value column for each drug; an empty value is unobserved.

    Returns obs(i, j, r), row labels (i, ...) and column labels (j, drug). Rows are numbered in file order: empty labels
    (null) and equal ones name rows of their own."""
    head = spark.read.option("sep", sep).option("header", False).csv(path).first()
    drugs = [str(h) for h in head[3:]]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in LABELS] + [T.StructField(f"v{k}", T.DoubleType()) for k in range(len(drugs))])
    wide = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("nullValue", "").schema(schema).csv(path)
    wide = _numbered(wide, "i")
    rows = wide.select("i", *LABELS)
    stacked = ", ".join(f"{k}L, `v{k}`" for k in range(len(drugs)))
    obs = wide.selectExpr("i", f"stack({len(drugs)}, {stacked}) as (j, r)").where("r is not null")
    return obs, rows, spark.createDataFrame(list(enumerate(drugs)), "j long, drug string")


def read_masked(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table of numbers without header or labels; NaN is unobserved. Lines are numbered in file order."""
    return read_matrix(spark, path, sep).where(~F.isnan("r"))


def read_matrix(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """Text of numbers, a matrix row a line: obs(i, j, r), lines numbered in file order."""
    line = F.regexp_replace(F.trim("value"), r"\r$", "")
    cells = _numbered(spark.read.text(path), "i", F.trim(line) != "").select("i", F.posexplode(F.split(F.trim(line), sep)).alias("j", "v"))
    return cells.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.expr("try_cast(v as double)").alias("r"))


def nonnegative(obs: DataFrame, rows: int, columns: int) -> DataFrame:
    """obs with shifted = r - (least - 1); the least is over the zero-filled matrix, so at most 0 where a cell is missing."""
    return _shift(obs, F.col("r"), rows, columns, F.lit(1.0))


def negate(obs: DataFrame, rows: int, columns: int) -> DataFrame:
    """obs with shifted = -r - least(-r), the least over the zero-filled negated matrix."""
    return _shift(obs, -F.col("r"), rows, columns, F.lit(0.0))


def _shift(obs: DataFrame, value, rows: int, columns: int, above) -> DataFrame:
    least = obs.agg(F.min(value).alias("_least"), F.count("*").alias("_n"))
    least = least.select(F.when(F.col("_n") < rows * columns, F.least("_least", F.lit(0.0))).otherwise(F.col("_least")).alias("_least"))
    return obs.join(F.broadcast(least)).withColumn("shifted", value - (F.col("_least") - above)).drop("_least")  # one row


def write_sensitivity(obs: DataFrame, rows: DataFrame, drugs: list[str], path: str, value: str = "r") -> None:
    """Tab separated with a header; missing cells are empty."""
    wide = obs.groupBy("i").pivot("j", list(range(len(drugs)))).agg(F.first(value))
    wide = rows.join(wide, "i", "left").orderBy("i").drop("i").toDF(*LABELS, *drugs)
    wide.write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_kernel(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A square matrix with a header line: obs(i, j, r)."""
    all_ = read_matrix(spark, path, sep)
    return all_.where("i > 0").withColumn("i", F.col("i") - 1)


def read_features(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Features without the header line and the name column: obs(i, j, r)."""
    return read_kernel(spark, path, sep).where("j > 0").withColumn("j", F.col("j") - 1)


def write_matrix(values, path: str) -> None:
    """A small matrix as whitespace text, a row a line."""
    with open(path, "w") as out:
        out.writelines(" ".join(repr(float(x)) for x in row) + "\n" for row in values)


def write_results(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
