"""Every query with SQL gives in Spark what its SQL gives in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest

from tests.conftest import DATA
from textmend import catalog

duckdb = pytest.importorskip("duckdb")
NAMES = sorted(catalog.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_in_both_engines(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_rows_only(spark, duck, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


def test_queries_have_names_of_their_own():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 90
