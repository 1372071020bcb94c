from pyspark.sql import functions as F

from ..licenses import scan

NAME = "op5_licenses"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    out, c = scan(files, all_words=True, keep_text=False)
    return out.select("doc_id", "path", *(F.col(c[x]).alias(x) for x in ("license", "score", "line", "inherited", "inherited_from", "effective")))
