"""Registered queries against their SQL in DuckDB, and the plans that matter at scale."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillspan.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"gbm_scores"}
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v if isinstance(v, (bool, int)) or v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) & set(QUERIES)))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(tidy(r[c]) for c in cols) for r in df.collect())
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = Counter(tuple(tidy(r[names.index(c)]) for c in cols) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["jump_ratio", "annual_rollup", "robustness", "live_counts", "history_as_of"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["complete_years"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_partkey" not in plan
