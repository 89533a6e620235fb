"""Every query of the store against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from shardwise.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
