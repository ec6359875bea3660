"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from weftline import plans

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).map(lambda v: float(v) if isinstance(v, float) else v).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, con, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), con.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
