"""Every query of the engine against DuckDB on the same tables."""

import math

import duckdb
import pytest
from conftest import SF

from lumenframe import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_matches_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    other = duck.execute(Q.ORACLE[name])
    names = [x[0] for x in other.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in other.fetchall())


def test_every_query_has_an_oracle():
    assert set(Q.QUERIES) == set(Q.ORACLE)
