"""Calibration, uncertainty, drift and outages on small hand-made tables."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillspan.functions import stats
from quillspan.operators import calibration as cal
from quillspan.operators import counts, uncertainty

MONTH = "year int, month int, region string, season string, count_a long, raw_b long, celldays_b long"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_ratio_by_group_recovers_the_scale(spark):
    m = spark.createDataFrame([(2012, 3, "hills", "burn", 10, 0, 20), (2013, 3, "hills", "burn", 30, 0, 60), (2012, 3, "plains", "burn", 5, 0, 50)], MONTH)
    f = {r["region"]: r["factor"] for r in rows(cal.ratio_by_group(m))}
    assert f == {"hills": 0.5, "plains": 0.1}
    back = cal.harmonize(m, cal.ratio_by_group(m), 2012).collect()
    assert sorted(r.harmonized for r in back) == [5, 10, 30]


def test_harmonize_switches_at_the_overlap_and_unknown_groups_are_null(spark):
    m = spark.createDataFrame([(2010, 3, "hills", "burn", 7, None, None), (2015, 3, "hills", "burn", 9, 0, 20), (2015, 3, "plains", "burn", 9, 0, 20)], MONTH)
    f = spark.createDataFrame([("hills", "burn", 0.5)], "region string, season string, factor double")
    got = {(r.year, r.region): r.harmonized for r in cal.harmonize(m, f, 2012).collect()}
    assert got == {(2010, "hills"): 7.0, (2015, "hills"): 10.0, (2015, "plains"): None}


def test_unseen_group_has_ratio_one_in_prediction(spark):
    train = spark.createDataFrame([(2012, 3, "hills", "burn", 10, 40, 20)], MONTH)
    test = spark.createDataFrame([(2013, 3, "plains", "off", 0, 8, 6)], MONTH)
    got = {r.method: r.pred for r in cal.predict(train, test).collect()}
    assert got["region"] == 6.0 and got["climatology"] == 0.0 and got["global_celldays"] == 3.0 and got["naive"] == 8.0


def test_climatology_is_the_mean_of_the_month(spark):
    train = spark.createDataFrame([(2012, 3, "hills", "burn", 100, 1, 1), (2013, 3, "hills", "burn", 300, 1, 1)], MONTH)
    test = spark.createDataFrame([(2014, 3, "hills", "burn", 0, 1, 1)], MONTH)
    assert [r.pred for r in cal.predict(train, test).filter("method = 'climatology'").collect()] == [200.0]


def test_leave_one_out_equals_refitting(spark):
    data = [(y, m, g, "burn" if m == 3 else "off", (y * 7 + m * 3 + len(g)) % 50, (y * 5 + m) % 90 + 1, (y * 3 + m) % 40 + 1) for y in (2012, 2013, 2014) for m in (3, 8) for g in ("hills", "plains")]
    m = spark.createDataFrame(data, MONTH)
    got = {(r.method, r.year, r.month, r.region): r.pred for r in cal.leave_one_year_out(m).collect()}
    for y in (2012, 2013, 2014):
        for r in cal.predict(m.filter(F.col("year") != y), m.filter(F.col("year") == y)).collect():
            assert math.isclose(r.pred, got[(r.method, r.year, r.month, r.region)])


def test_score_by_group(spark):
    data = [(y, mo, "hills", "burn" if mo == 3 else "off", float(t), float(p)) for y, p in ((2020, (110, 10)), (2021, (90, 10))) for mo, t, p in ((3, 100, p[0]), (8, 10, p[1]))]
    s = spark.createDataFrame(data, "year int, month int, region string, season string, actual double, pred double").withColumn("method", F.lit("m"))
    got = {r.season: r for r in cal.score_by_group(s).collect()}
    assert math.isclose(got["burn"].median_err_pct, 10) and math.isclose(got["off"].bias_pct, 0) and got["burn"].yearly_r is None


def test_constant_ratio_has_no_width(spark):
    m = spark.createDataFrame([(y, mo, "hills", s, 40, 0, 100) for y in range(2012, 2020) for mo, s in ((3, "burn"), (8, "off"))], MONTH)
    f = uncertainty.bootstrap_factors(m, uncertainty.random_draws(spark, list(range(2012, 2020)), 50))
    assert {r.factor for r in f.select("factor").distinct().collect()} == {0.4} and f.count() == 100
    b = uncertainty.band(uncertainty.replicate_series(m, f, 2012), ["year", "month"]).collect()
    assert all(r.lo == r.hi == 40 for r in b)


def test_bootstrap_equals_resampling_whole_years(spark):
    data = [(y, mo, "hills", "burn", y * mo % 37, 0, y * mo % 53 + 1) for y in (1, 2, 3) for mo in (2, 3)]
    draws = spark.createDataFrame([(0, 1, 2), (0, 3, 1)], "rep int, year int, times int")
    got = uncertainty.bootstrap_factors(spark.createDataFrame(data, MONTH), draws).first().factor
    picked = [d for y in (1, 1, 3) for d in data if d[0] == y]
    assert math.isclose(got, sum(d[4] for d in picked) / sum(d[6] for d in picked))


def detections(spark, data):
    return spark.createDataFrame(data, "satellite string, date date, year int, month int, hhmm int, daynight string, kind int, sensor string")


def test_gap_months(spark):
    data = []
    for y, m, terra, aqua in ((2021, 4, 20, 25), (2022, 4, 18, 8), (2022, 7, 3, 0)):
        for sat, n in (("Terra", terra), ("Aqua", aqua)):
            data += [(sat, date(y, m, 1) + timedelta(days=d), y, m, 715, "D", 0, "A") for d in range(n)]
    assert [(r.year, r.month) for r in counts.gap_months(detections(spark, data), 2003).collect()] == [(2022, 4)]


def test_drift(spark):
    data = [("Aqua", date(y, 1, 1), y, 1, 800 if y == 2024 else 840 if y == 2025 else 715, "D", 0, "A") for y in range(2012, 2026)]
    data += [("Aqua", date(2014, 1, 1), 2014, 1, 100, "N", 0, "A")]
    got = counts.overpass_drift(detections(spark, data), (2012, 2021)).collect()
    assert {r.baseline for r in got} == {13.25} and sorted(r.year for r in got if r.drifted) == [2024, 2025]


def test_cell_days_take_the_first_row_of_a_boundary_cell(spark):
    d = spark.createDataFrame([(2, date(2012, 3, 1), 21.001, 92.001, "plains"), (1, date(2012, 3, 1), 21.002, 92.002, "hills"), (3, date(2012, 3, 1), -0.001, 92.001, "hills")], "id long, date date, lat double, lon double, region string")
    got = {(r.fi, r.fj): r.region for r in counts.cell_days(d).collect()}
    assert got == {(2100, 9200): "hills", (-1, 9200): "hills"}


def test_trend(spark):
    s = spark.createDataFrame([(2003 + i, 100.0 - 3 * i) for i in range(20)], "year int, v double")
    r = stats.kendall_theilsen(s, "year", "v").first()
    assert (r.tau, r.slope, r.n) == (-1.0, -3.0, 20)
    assert stats.kendall_theilsen(s.limit(0), "year", "v").count() == 0


@pytest.mark.parametrize(("n", "tau", "p"), [(24, -0.493, 0.0005), (23, -0.502, 0.0006)])
def test_exact_p_of_published_trends(n, tau, p):
    s = round(tau * n * (n - 1) / 2)
    assert round(stats.kendall_p(n, s), 4) == p


def test_exact_p_of_small_samples():
    assert stats.kendall_p(4, 6) == 2 / 24 and stats.kendall_p(3, 0) == 1.0
    assert math.isclose(stats.mann_whitney_p(3, 3, 9), 1 / 20) and math.isclose(stats.mann_whitney_p(3, 3, 0), 1.0)
    assert stats.mann_whitney_p(20, 20, 400) < 1e-6


def test_empty_tables(spark):
    m = spark.createDataFrame([], MONTH)
    assert cal.ratio_by_group(m).count() == 0 and cal.leave_one_year_out(m).count() == 0 and cal.score_overall(cal.leave_one_year_out(m)).count() == 0
