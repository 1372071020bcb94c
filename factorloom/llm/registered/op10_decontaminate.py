from pyspark.sql import functions as F

from ..decontaminate import is_contaminated, scan

NAME = "op10_decontaminate"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), grams AS (
  SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, (SELECT DISTINCT size FROM windows))
), found AS (
  SELECT doc_id, k, g.size, item FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, c = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.col(c["items"])
    return out.select(
        "doc_id", F.col(c["n_words"]).alias("n_words"), F.col(c["n_hit"]).alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), is_contaminated(c).alias("contaminated"),
    )
