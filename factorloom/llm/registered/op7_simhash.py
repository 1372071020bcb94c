from pyspark.sql import functions as F

from ..simhash import classes, hex16

NAME = "op7_simhash"


def query(spark, sf_dir):
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
