"""Every query that has an oracle, against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, Decimal)):  # DuckDB's literals with a point are decimals
        return round(float(value), 9)
    return str(value)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())))
def test_rows_only(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
