"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import pytest

from gridloom.catalog import REGISTERED

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


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", REGISTERED)
def test_matches_sql(spark, oracle, name):
    query, sql = REGISTERED[name]
    df = query(spark, str(FOLDER))
    found = table(df.columns, df.collect())
    result = oracle.execute(sql)
    assert found == table([d[0] for d in result.description], result.fetchall())


def test_no_query_is_cut_short():
    assert len(REGISTERED) > 60 and all(sql for _, sql in REGISTERED.values())
