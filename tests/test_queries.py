"""Every query with SQL against DuckDB over the smallest tables, and the others for rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillmill.plans import catalogue


def plain(df):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")):
            return round(float(v), 6)
        return str(v)

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    ours = catalogue.queries()[name](spark, data).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_plans_push_down_and_prune(spark, data):
    plan = catalogue.queries()["large_notes"](spark, data)._jdf.queryExecution().toString()
    assert "GreaterThan(content_length" in plan and "ReadSchema: struct<guid:string,content_length" in plan
    plan = catalogue.queries()["cache_misses"](spark, data)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "summary" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name, table", [("rank_candidates_all", "search_hits"), ("log_order_all", "parsed_notes")])
def test_whole_tables_come_out(spark, data, name, table):
    guids = catalogue.queries()[name](spark, data).select("guid").distinct().count()
    assert guids == spark.read.parquet(f"{data}/{table}.parquet").select("guid").distinct().count()
