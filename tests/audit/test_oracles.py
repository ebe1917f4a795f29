"""Every audit query against its SQL twin."""

import duckdb
import pandas as pd
import pytest

from vellum.plans.oracles import oracle_sql
from vellum.plans.queries import queries

QUERIES, SQL = queries(), oracle_sql()


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    assert sorted(ours) == sorted(theirs)
    assert rows(ours) == rows(theirs)
    assert len(ours) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
