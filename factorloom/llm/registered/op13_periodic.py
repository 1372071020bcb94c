from pyspark.sql import functions as F

from ..periodic import find_runs

NAME = "op13_periodic"


def planted(docs):
    """doc_id and text, where the checksum of the id is a multiple of ten with a tail that repeats its first words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text"), "[ \\t-\\r]+"), lambda w: w != "")
    plan = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda x: F.struct(x.w.alias("w"), F.size(x.w).cast("long").alias("n"), x.g.alias("g"), (x.g % F.greatest(F.size(x.w), F.lit(1))).alias("a")))
    plan = F.transform(plan, lambda x: F.struct(x.w.alias("w"), x.n.alias("n"), x.a.alias("a"), (1 + F.floor((x.n - x.a) / (3 + x.g % 8))).alias("p")))
    place = lambda x, i: F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p)
    made = F.transform(plan, lambda x: F.when(x.n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x.n - 1), lambda i: F.get(x.w, place(x, i).cast("int"))), " ")).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(made, F.lit(0))).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir):
    out, c = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    runs = F.col(c["runs"])
    # The longest, of these the first, of these the one of the smallest period.
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    out = out.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col(c["collapsed"]), 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
