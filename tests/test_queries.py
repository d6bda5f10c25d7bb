"""Every query against its SQL on the smallest tables."""

import glob

import duckdb
import pandas as pd
import pytest

from tracelink.plans import landed, queries, sql, studies

QUERIES, SQL = queries.queries() | landed.queries() | studies.queries(), sql.oracle_sql() | landed.oracle_sql() | studies.oracle_sql()


def plain(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in frame.values.tolist())


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_semi_join_is_broadcast_and_pruned(spark, data):
    e, p = queries.edges(spark, data), queries.papers(spark, data).where("year <= 1998")
    from tracelink.operators import links

    plan = links.cited_by(e, p, "oaid")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "l_extendedprice" not in plan
