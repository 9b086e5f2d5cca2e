"""Every registered query with a DuckDB counterpart gives the same rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lumenpick.plans.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([row[i] for i in order] for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
