"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["part", "lineitem", "pages", "documents", "embeddings", "conversations"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    exp = sorted((tuple(norm(row[names.index(c)]) for c in cols) for row in found.fetchall()), key=repr)
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "waste_score" in df.columns
