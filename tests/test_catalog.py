"""Every query with a DuckDB counterpart gives the same rows; the others run."""

import os

import duckdb
import pytest

from chronotrack.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df, columns):
    shown = lambda v: "" if v is None else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    d = df[columns].astype(object)
    return d.where(d.notna(), None).map(shown).sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert plain(a, columns).equals(plain(b, columns))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) > 0
