"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from closebook.plans.oracle import ORACLE_SQL
from closebook.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def value(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    want = duck.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    places = [want.columns.index(n) for n in names]
    ours = in_order(tuple(value(row[n]) for n in names) for row in got.collect())
    theirs = in_order(tuple(value(row[i]) for i in places) for row in want.fetchall())
    assert ours == theirs
    assert ours
