"""Every registered query equals its DuckDB twin on the smallest test data."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from pliego.plans import deliveries, registry  # noqa: F401
from pliego.sources.tables import TABLES

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.9g}")
        return x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(NAMES) <= set(E.oracle_sql()) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, cur.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "NF039" in df.columns
