"""Every tracking query with SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from trackloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("embeddings", "events")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(([_plain(r[c]) for c in names] for r in df.collect()), key=repr)
    assert rows == sorted(([_plain(v) for v in r] for r in found.fetchall()), key=repr)


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
