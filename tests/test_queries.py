"""Each registered query on bars against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from barspark.plans import months, sweeping
from barspark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for table in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return c


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=str)


MORE = sweeping.QUERIES | months.QUERIES
MORE_SQL = sweeping.ORACLE_SQL | months.ORACLE_SQL


def test_every_query_has_sql():
    """But for sweeps, which have a loop in test_sweeps.py."""
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(MORE) - set(MORE_SQL) == {"liquidity_sweeps", "sweep_health"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) + sorted(MORE_SQL))
def test_query_matches_sql(spark, db, name):
    df = (QUERIES | MORE)[name](spark, SF)
    result = db.execute((ORACLE_SQL | MORE_SQL)[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.collect(), df.columns) == _rows(result.fetchall(), columns)
