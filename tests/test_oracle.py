"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from litmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(x):
    if x is None or str(x) in ("nan", "NaT", "<NA>"):
        return "~"
    return f"{x:.9g}" if isinstance(x, float) else str(x).replace(" 00:00:00", "")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    ints = [c for c in got if str(want[c].dtype).lower().startswith("int")]
    got[ints], want[ints] = got[ints].astype("Int64"), want[ints].astype("Int64")
    assert rows(got) == rows(want)
