from pyspark.sql import functions as F

from ..ranked import search

NAME = "op11_ranked"

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH asked AS (
  SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), sized AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), stats AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM held, stats GROUP BY term
), impacts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS impact FROM held JOIN weights USING (term), stats
), scores AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 50
"""


def query(spark, sf_dir):
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    found = search(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
