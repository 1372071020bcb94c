"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents; the last returns each document's token ids and what they decode to.

Cases: documents of a null text, or of one without a letter, go. Of rows that repeat an id one is left, the one whose
text comes first; rows of null ids are near-duplicates of one another like any others, and each component of theirs
keeps one. Very long texts are read whole. Extra columns, of whatever names, stay up to the last stage. An empty table
gives an empty table; a benchmark of null or empty items removes nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, language, pieces, simhash, substrings
from factorloom.llm.common import forget, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go."""
    return language.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the smallest id."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in their first document and are cut from all others; n_chars follows the text."""
    out = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is benchmark text go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with begin and end, and the text that they decode to."""
    out, c = pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    return out.select("doc_id", *(F.col(c[x]).alias(x) for x in ("n_tokens", "ids", "decoded")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_contamination", benchmark_contamination),
    ("tokens", tokens),
]

#: SQL cannot express the stages: the recurrent network, components of near-duplicates and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir))
        forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
