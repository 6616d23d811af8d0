"""Every library query against its DuckDB SQL, over the smallest tables."""

import math

import duckdb
import pytest

from sluice.plans import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    df = library.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in library.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(library.ORACLE_SQL[name])
    names = want.columns
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in want.fetchall())
