from pyspark.sql import functions as F

from ..language import held_out, identify, train

NAME = "op8_language"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.select("doc_id", "text", "lang"), ~held_out())
    out, c = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), F.col(c["lang_pred"]).alias("lang_pred"), F.col(c["score"]).alias("score"))
