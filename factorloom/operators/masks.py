"""Masks, splits and folds of observed cells obs(i, j, ...), as DataFrame operations.

A random order is that of md5(seed|i|j): the same on any engine and under any partitioning. Global ranks come from
counts of 4096 hash buckets and a rank inside each, so no window runs over all cells.

Masks, splits and folds that must leave no row and no column without a training cell come in two kinds: try_* draw again
until that holds, covering_* keep an edge cover (of each row and of each column the cell of least hash) out of what is
tested, which needs one attempt on any matrix.

Cases: extra columns stay, whatever their names (a column called split or fold is replaced where one is made); cells of a
null i or j are cells of a row or column null; cells that repeat are ranked one after another; an empty table gives an
empty table.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import deleted, written


def shuffle_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df lacks (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ranked(df: DataFrame, key: Column, ties: list[str], name: str = "p") -> DataFrame:
    """df with the 0-based rank of its rows by an md5 key (ties by columns)."""
    key_name, bucket, before = (unused(df, x) for x in ("_key", "_bucket", "_before"))
    keyed = df.withColumn(key_name, key).withColumn(bucket, F.substring(key_name, 1, 3))
    less = F.coalesce(F.sum("n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keyed.groupBy(bucket).agg(F.count("*").alias("n")).select(bucket, less.alias(before))  # 4096 rows at most
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(key_name, *ties)) - 1
    out = keyed.join(F.broadcast(offsets), bucket)
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()), (rank + F.col(before)).cast("bigint").alias(name))


def dense_index(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers 0, 1, ... for the distinct values of a key, in md5 order."""
    return ranked(keys.select(key).distinct(), F.md5(F.col(key).cast("string")), [key], name)


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """All index pairs, from one range."""
    return spark.range(rows * columns).select(F.expr(f"id div {columns}").alias("i"), (F.col("id") % columns).alias("j"))


def _part(rows: int, columns: int, fraction: float, left: bool = False) -> int:
    """int(rows * columns * fraction), or with left of 1 - fraction, of the fraction as it is written: no product is rounded."""
    exact = Fraction(str(fraction))
    return int(rows * columns * (1 - exact if left else exact))


def random_mask(spark: SparkSession, rows: int, columns: int, fraction: float, seed: int) -> DataFrame:
    """The pairs left when exactly int(rows * columns * fraction) are taken out."""
    return _marked(grid(spark, rows, columns), seed, lambda p: p >= _part(rows, columns, fraction), "kept").where("kept").drop("kept")


def _marked(obs: DataFrame, seed: int, value, name: str) -> DataFrame:
    """obs with a column made of the rank of its cells, which itself goes."""
    p = unused(obs, "p")
    return ranked(obs, shuffle_key(seed, "i", "j"), ["i", "j"], p).withColumn(name, value(F.col(p))).drop(p)


def split(obs: DataFrame, rows: int, columns: int, fraction: float, seed: int) -> DataFrame:
    """obs with split "train" for int(rows * columns * (1 - fraction)) cells and "test" for the rest; the fraction is of all cells."""
    keep = _part(rows, columns, fraction, left=True)
    return _marked(obs, seed, lambda p: F.when(p < keep, "train").otherwise("test"), "split")


def check_split(obs: DataFrame, rows: int, columns: int, fraction: float) -> None:
    missing = rows * columns - obs.count()
    if not missing < rows * columns * fraction:
        raise ValueError(f"Specified {fraction} fraction missing, but {missing} cells are missing already.")


def folds(obs: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """obs with a fold for each cell: ranks cut at int(f * n / n_folds)."""
    n = obs.count()
    return _marked(obs, seed, lambda p: F.floor(((p + 1) * n_folds - 1) / F.lit(max(n, 1))).cast("int"), "fold")


def folds_of(obs: DataFrame, axis: str, first: int, n_folds: int, seed: int) -> DataFrame:
    """Folds over the first rows (axis i) or columns (axis j) only; other cells always train (fold -1)."""
    inside = folds(obs.where(F.col(axis) < first), n_folds, seed)
    return inside.unionByName(obs.where(F.col(axis) >= first).withColumn("fold", F.lit(-1)))


def round_robin(obs: DataFrame, n_folds: int, seed: int) -> DataFrame:
    return _marked(obs, seed, lambda p: (p % n_folds).cast("int"), "fold")


def coverage(obs: DataFrame, axis: str) -> DataFrame:
    """The cells of each row (or column) that has any."""
    return obs.groupBy(axis).agg(F.count("*").alias("cells"))


def covers(obs: DataFrame, rows: int, columns: int) -> bool:
    """Whether each row and column has a cell."""
    seen = obs.agg(F.countDistinct("i").alias("i"), F.countDistinct("j").alias("j")).first()
    return seen.i == rows and seen.j == columns


def lost_lines(folded: DataFrame, axis: str) -> DataFrame:
    """Rows (or columns) that some training mask would leave empty: all their cells lie in one fold."""
    return folded.groupBy(axis).agg(F.min("fold").alias("fold"), F.max("fold").alias("_top"), F.count("*").alias("cells")).where((F.col("fold") == F.col("_top")) & (F.col("fold") >= 0)).drop("_top")


def attempt(make, fits, attempts: int, seed: int):
    """The first of make(seed), make(seed + 1), ... that fits."""
    for k in range(attempts):
        made = make(seed + k)
        if fits(made):
            return made
    raise ValueError(f"Failed to generate masks that cover all rows and columns, with {attempts} attempts.")


def try_mask(spark, rows: int, columns: int, fraction: float, attempts: int, seed: int) -> DataFrame:
    return attempt(lambda s: random_mask(spark, rows, columns, fraction, s), lambda m: covers(m, rows, columns), attempts, seed)


def try_split(obs: DataFrame, rows: int, columns: int, fraction: float, attempts: int, seed: int) -> DataFrame:
    check_split(obs, rows, columns, fraction)
    return attempt(lambda s: split(obs, rows, columns, fraction, s), lambda m: covers(m.where("split = 'train'"), rows, columns), attempts, seed)


def try_folds(obs: DataFrame, n_folds: int, attempts: int, seed: int) -> DataFrame:
    return attempt(lambda s: folds(obs, n_folds, s), lambda m: lost_lines(m, "i").isEmpty() and lost_lines(m, "j").isEmpty(), attempts, seed)


def cover(obs: DataFrame, seed: int) -> DataFrame:
    """Pairs (i, j), once each, that touch every row and column of obs: of each the cell of least md5(seed|i|j)."""
    cells = obs.select("i", "j", shuffle_key(seed, "i", "j").alias("k"))
    rows = cells.groupBy("i").agg(F.min(F.struct("k", "j")).alias("least")).select("i", "least.j")
    columns = cells.groupBy("j").agg(F.min(F.struct("k", "i")).alias("least")).select("least.i", "j")
    return rows.union(columns).distinct()


def _beside_cover(obs: DataFrame, seed: int, name: str) -> DataFrame:
    """obs with a column that says whether the cell is one of its cover."""
    i, j = unused(obs, "_i"), unused(obs, "_j")
    held = cover(obs, seed).toDF(i, j).withColumn(name, F.lit(True))  # each pair once
    out = obs.join(held, F.col("i").eqNullSafe(F.col(i)) & F.col("j").eqNullSafe(F.col(j)), "left")
    return out.select(*(F.col(f"`{c}`") for c in obs.columns), F.coalesce(name, F.lit(False)).alias(name))


def covering_folds(obs: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """obs with a fold for each cell outside its cover, whose cells always train (fold -1): no training part leaves a row
    or column empty, and the folds are as large as folds() makes them of the rest. The result is a written table (deleted()
    deletes it), so that what reads it several times does not join and rank again."""
    name = unused(obs, "_cover")
    parts = written(_beside_cover(obs, seed, name))
    inside = folds(parts.where(~F.col(name)).drop(name), n_folds, seed)
    out = written(inside.unionByName(parts.where(name).drop(name).withColumn("fold", F.lit(-1))))
    deleted(parts)
    return out


def covering_split(obs: DataFrame, rows: int, columns: int, fraction: float, seed: int) -> DataFrame:
    """Like split(), the cells of the cover first among those that train."""
    return _covering(obs, _part(rows, columns, fraction, left=True), seed)


def _covering(obs: DataFrame, keep: int, seed: int) -> DataFrame:
    name = unused(obs, "_cover")
    parts = written(_beside_cover(obs, seed, name))
    held = parts.where(name)
    n = held.count()
    if n > keep:
        deleted(parts)
        raise ValueError(f"{n} cells are needed to cover all rows and columns, and {keep} may train.")
    inside = _marked(parts.where(~F.col(name)), seed, lambda p: F.when(p < keep - n, "train").otherwise("test"), "split")
    out = written(inside.unionByName(held.withColumn("split", F.lit("train"))).drop(name))
    deleted(parts)
    return out


def covering_mask(spark: SparkSession, rows: int, columns: int, fraction: float, seed: int) -> DataFrame:
    """Like random_mask(), but no row and no column is left without a pair."""
    made = _covering(grid(spark, rows, columns), rows * columns - _part(rows, columns, fraction), seed)
    return made.where("split = 'train'").drop("split")


def training(folded: DataFrame, fold: int) -> DataFrame:
    return folded.where(F.col("fold") != fold)


def complement(obs: DataFrame, rows: int, columns: int) -> DataFrame:
    return grid(obs.sparkSession, rows, columns).join(obs.select("i", "j"), ["i", "j"], "left_anti")


def index_lists(obs: DataFrame, by: str, other: str) -> DataFrame:
    """For each row (or column) its observed columns (rows), ascending."""
    return obs.groupBy(by).agg(F.sort_array(F.collect_list(other)).alias("indices"))


def recover_predictions(obs: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth and prediction of the cells that are not observed."""
    return truth.join(obs.select("i", "j"), ["i", "j"], "left_anti").join(predicted, ["i", "j"])
