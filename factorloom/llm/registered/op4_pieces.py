import public_tokenizers

from ..pieces import encode

NAME = "op4_pieces"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, c = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True, keep_text=False)
    return out.select("doc_id", *(out[c[x]].alias(x) for x in ("n_tokens", "ids_sha256", "decoded_sha256")))
