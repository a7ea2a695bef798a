"""Every training-data query with SQL gives the same rows in another engine, on the smallest tables."""

import duckdb
import pytest

from quayside.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    ours = queries.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(ours.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted((list(r) for r in ours.select(*names).collect()), key=key) == sorted((list(r) for r in found.fetchall()), key=key)
