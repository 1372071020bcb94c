from ..fingerprint import fingerprints

NAME = "op1_fingerprint"


def query(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
