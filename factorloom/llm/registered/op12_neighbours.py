from ..neighbours import every, search

NAME = "op12_neighbours"


def query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(every(20)))
