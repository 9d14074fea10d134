"""Registered corpus queries beside their SQL, where SQL can express them."""

import duckdb
import pytest

from tidemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    own = queries.QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in own.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in result.fetchall())
