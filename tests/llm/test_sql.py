"""The queries that SQL can express, against their SQL on the same tables."""

import os

import duckdb
import pytest

from motifdrift.llm import entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        path = f"{SF}/{table}.parquet"
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    out, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    names = sorted(out.columns)
    assert sorted(want.columns) == names
    found = sorted(str(tuple(r)) for r in out.select(names).collect())
    assert found == sorted(str(r) for r in want.select(*names).fetchall())
    assert found
