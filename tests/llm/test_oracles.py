"""The queries that have SQL against it."""

import duckdb
import pytest

from tests.test_entry import SF, TABLES, rows
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
