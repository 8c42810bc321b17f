"""The registered queries of the subpackage against their SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

from gridloom.llm.queries import QUERIES

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    if not FOLDER.exists():
        pytest.skip("no test data")
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, oracle, name):
    query, sql = QUERIES[name]
    frame = query(spark, str(FOLDER))
    result = oracle.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    got, want = (sorted(map(repr, map(tuple, rows))) for rows in (frame.select(columns).collect(), result.fetchall()))
    assert len(got) > 0 and got == want
