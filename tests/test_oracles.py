"""Every registered query of the rest of the library against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quarry.plans.inputs import TABLES
from quarry.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall())
