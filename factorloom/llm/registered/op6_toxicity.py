from pyspark.sql import functions as F

from ..toxicity import held_out, score, train

NAME = "op6_toxicity"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), ~held_out())
    out, s = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.7).cast("int").alias("predicted"))
