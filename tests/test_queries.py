"""Every registered query of the library runs on the smallest tables and agrees with its SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

from fieldbook.plans import registry

SF = os.environ.get("FIELDBOOK_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}" if float(v) != int(v) else str(int(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    got = df.collect()
    if sql is None:
        assert df.columns
        return
    expected = duck.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, got) == rows_of(expected.columns, expected.fetchall())


def test_the_flagship_gives_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(1, len(rows) + 1))
