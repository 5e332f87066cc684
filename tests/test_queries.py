import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.plans import analytics


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if type(x).__name__ in ("Decimal", "float") else str(x)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


CHECKED = [*analytics.SQL, "p3_found", "p3_hours", "p3_revisions", "p4_found", "p4_peers", "p4_grammars", "dedupe_seen", "step_kv", "step_json", "clock_bsd_year"]


@pytest.mark.parametrize("name", CHECKED)
def test_as_sql_says(spark, duck, small, name):
    got = entry.queries()[name](spark, small)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(rel.columns, row))) for row in rel.fetchall()), key=str)
    assert mine == theirs


def test_all_queries_are_named_and_callable():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
