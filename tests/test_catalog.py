"""Every query with SQL gives what DuckDB gives; those without give rows."""

from __future__ import annotations

import duckdb
import pytest

from signalwright.plans import catalog
from signalwright.sources.readers import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    assert sorted(d[0] for d in want.description) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(repr(tuple(plain(r[k]) for k in order)) for r in want.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in got.select(*columns).collect()) == rows
    assert rows


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
