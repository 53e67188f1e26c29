"""Every query with SQL against DuckDB on the small tables."""

import math

import duckdb
import pytest

from tarnflow import queries

TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1.0, abs(x))) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, db, name):
    got = queries.QUERIES[name](spark, sf)
    want = db.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=str)
    assert len(a) == len(b) and (a == b or all(map(close, a, b)))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    assert got.columns
    rows = got.collect()
    assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_flows_lose_nothing(spark, sf):
    """Daily and monthly totals hold every row of the table."""
    total = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").first()[0]
    for name in ("flow_daily_densified", "monthly_totals"):
        assert queries.QUERIES[name](spark, sf).selectExpr("sum(q)").first()[0] == total
