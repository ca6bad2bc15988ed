"""Corpus queries against the SQL that is registered for them."""

import duckdb
import pandas as pd
import pytest

from evidentia.llm import registry
from tests.test_catalog import SF, rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF)
    got, want = pd.DataFrame(found.collect(), columns=found.columns, dtype=object), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
