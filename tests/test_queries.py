"""Every query of the engine against its SQL in DuckDB, and the plans of some."""

import os

import duckdb
import pytest

from quern.queries import QUERIES, SQL, catalog_of


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def rows(records, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([r[i] for i in order] for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.collect(), df.columns)
    if name in SQL:
        found = con.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(found.fetchall(), names)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["rel_minimum"](spark, sf_dir))
    assert "EqualTo(c_mktsegment,MACHINERY)" in text and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in text
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "StringStartsWith(p_name,red)" in plan(QUERIES["rel_like"](spark, sf_dir))
    assert "Python" not in plan(QUERIES["graph_navigate"](spark, sf_dir)) and "NestedLoop" not in plan(QUERIES["graph_navigate"](spark, sf_dir))


def test_one_catalog(spark, sf_dir):
    assert {"customer", "docs", "sales", "partsize", "observation_evidence", "users"} <= set(catalog_of(spark, sf_dir).sources)
