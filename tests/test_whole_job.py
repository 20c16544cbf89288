"""Registered queries read every row and do every repetition that their definition asks for."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillspan.config import CONFIG
from quillspan.plans import calendar, registry
from quillspan.plans.base import PARTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def result(spark, name):
    """Columns in order of name, and rows with their counts; doubles at 9 digits."""
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    return cols, Counter(tuple(tidy(r[c]) for c in cols) for r in df.collect())


def tidy(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v if isinstance(v, (bool, int)) or v is None else str(v)


def answer(duck, sql):
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    return cols, Counter(tuple(tidy(r[names.index(c)]) for c in cols) for r in got.fetchall())


@pytest.mark.parametrize("name", ["static_dilate", "static_members", "live_counts", "live_fires", "live_alerts", "bootstrap_factors", "factor_quantiles", "calendar_band", "annual_rollup"])
def test_whole_definition(spark, duck, name):
    """Static sources from all rows of other kinds; every slot of 2,000 replicates drawn by itself."""
    assert result(spark, name) == answer(duck, registry.oracle_sql()[name])


def test_sql_has_no_subset_of_ids():
    assert "%" not in PARTS["static"][1] and f"range({CONFIG.replicates})" in PARTS["draws"][1]


def test_replicates_mix_years(spark):
    reps = {}
    for r in calendar.draws(spark).collect():
        reps.setdefault(r.rep, {})[r.year] = r.times
    assert CONFIG.replicates == len(reps) == 2000 and all(sum(v.values()) == 3 for v in reps.values())
    # All 10 multisets of 3 years; 3 of 27 draws take one year alone, and each year is taken as often as the others.
    assert len({tuple(sorted(v.items())) for v in reps.values()}) == 10
    assert 0.08 < sum(len(v) == 1 for v in reps.values()) / 2000 < 0.15
    assert all(1850 < sum(v.get(y, 0) for v in reps.values()) < 2150 for y in calendar.FULL)


def test_trend_of_all_replicates(spark):
    assert registry.queries()["trend_replicates"](spark, SF).first().n == 2000
