"""Each registered query that has SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from factorloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(fix(r[k]) for k in order)) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert registry.entry(spark, SF).count() > 0
