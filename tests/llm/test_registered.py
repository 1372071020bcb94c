"""The queries that SQL can express, against DuckDB on the smallest tables; and the shape of all."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from factorloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(repr(tuple(r[k] for k in order)) for r in df.collect()) == sorted(repr(tuple(r[want.columns.index(k)] for k in order)) for r in want.fetchall())


def test_all_are_registered():
    names = set(queries.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{k}" for k in range(1, 14)}


def test_held_out_documents(spark):
    """Languages are told, and clean documents are left alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    said = queries.queries()["op8_language"](spark, SF).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    rows = said.collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.queries()["op6_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.05 * len(rows)
