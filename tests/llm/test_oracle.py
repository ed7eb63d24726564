"""The queries that SQL expresses, over whole tables, against DuckDB."""

import duckdb
import pytest

from stakelens.llm import oracle, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(oracle.sql()[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    expected = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    out = queries.queries()[name](spark, SF_DIR)
    assert sorted(out.columns) == names
    assert sorted((tuple(r) for r in out.select(*names).collect()), key=repr) == expected
