from pyspark.sql import functions as F

from ..substrings import repeats

NAME = "op3_substrings"


def query(spark, sf_dir):
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("pos").alias("first_word"), F.col("size").alias("n_words"), F.col("root_id").alias("class_doc_id"), F.col("root_pos").alias("class_first_word"), F.col("root_size").alias("class_n_words"), "removed")
