"""Queries over the monthly record: counts, calibration, uncertainty, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.config import CONFIG
from quillspan.functions import stats
from quillspan.operators import calibration as cal
from quillspan.operators import counts, uncertainty
from quillspan.operators.live import decode_confidence
from quillspan.plans.adapter import observations
from quillspan.plans.base import Book, part, q, r, rounded
from quillspan.staging import staged

BOOK = Book()
OUTAGES = [("1998-03-10", "1998-03-24"), ("1999-07-01", "1999-07-03"), ("1999-07-03", "1999-07-05")]
FULL = (1998, 1999, 2000)

part("cd", ("placed",), "SELECT date, fi, fj, arg_min(region, id) AS region, min(year) AS year, min(month) AS month FROM placed WHERE sensor = 'B' GROUP BY date, fi, fj")
part("spine", (), "SELECT CAST(m // 12 AS INT) AS year, CAST(m % 12 + 1 AS INT) AS month, region FROM range(1995 * 12, 2001 * 12 + 11) t(m) CROSS JOIN (VALUES ('hills'), ('plains')) v(region)")
part("months", ("placed", "cd", "spine"), """
SELECT s.year, s.month, s.region, coalesce(n.a, 0) AS count_a, CASE WHEN s.year >= 1998 THEN coalesce(n.b, 0) END AS raw_b,
  CASE WHEN s.year >= 1998 THEN coalesce(c.n, 0) END AS celldays_b, CASE WHEN s.month BETWEEN 2 AND 5 THEN 'burn' ELSE 'off' END AS season
FROM spine s
LEFT JOIN (SELECT year, month, region, count(*) FILTER (sensor = 'A') AS a, count(*) FILTER (sensor = 'B') AS b FROM veg GROUP BY ALL) n USING (year, month, region)
LEFT JOIN (SELECT year, month, region, count(*) AS n FROM cd GROUP BY ALL) c USING (year, month, region)""")
part("factors", ("months",), "SELECT region, season, sum(count_a) / greatest(sum(celldays_b), 1) AS factor FROM months WHERE year IN (1998, 1999, 2000) GROUP BY region, season")
part("harm", ("months", "factors"), "SELECT m.*, CASE WHEN year < 1998 THEN count_a ELSE celldays_b * factor END AS harmonized, CASE WHEN year < 1998 THEN count_a ELSE raw_b END AS naive FROM months m JOIN factors USING (region, season)")
part("draws", (), f"""
SELECT CAST(rep AS INT) AS rep, [1998, 1999, 2000][('0x' || substr(md5('boot-1|' || rep || '|' || slot), 1, 13))::BIGINT % 3 + 1] AS year, count(*) AS times FROM range({CONFIG.replicates}) a(rep) CROSS JOIN range(3) b(slot) GROUP BY ALL""")
part("boot", ("months", "draws"), """
SELECT rep, region, season, sum(times * a) / greatest(sum(times * b), 1) AS factor
FROM draws JOIN (SELECT year, region, season, sum(count_a) AS a, sum(celldays_b) AS b FROM months GROUP BY ALL) USING (year) GROUP BY rep, region, season""")
part("series", ("months", "boot"), "SELECT m.*, rep, CASE WHEN year < 1998 THEN count_a ELSE celldays_b * factor END AS value FROM months m JOIN boot USING (region, season)")


def months(spark, sf_dir):
    return staged(spark, sf_dir, "months", lambda: counts.monthly_counts(counts.vegetation(observations(spark, sf_dir))))


def full(spark, sf_dir):
    return months(spark, sf_dir).filter(F.col("year").isin(*FULL))


def harmonized(spark, sf_dir):
    m = months(spark, sf_dir)
    factors = cal.ratio_by_group(m.filter(F.col("year").isin(*FULL)))
    return cal.naive_stitch(cal.harmonize(m, factors))


def draws(spark):
    return uncertainty.hashed_draws(spark, list(FULL))


def replicate_series(spark, sf_dir):
    m = months(spark, sf_dir)
    return uncertainty.replicate_series(m, uncertainty.bootstrap_factors(m, draws(spark)))


@BOOK.add("conf_decode", q(("obs",), "SELECT conf_raw, CASE conf_raw WHEN 'l' THEN 20.0e0 WHEN 'n' THEN 60.0e0 WHEN 'h' THEN 90.0e0 ELSE try_cast(conf_raw AS DOUBLE) END AS conf, count(*) AS n FROM obs GROUP BY ALL"))
def conf_decode(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("conf_raw").agg(F.count("*").alias("n")).withColumn("conf", decode_confidence(F.col("conf_raw")))


@BOOK.add("vegetation_filter", q(("obs",), "SELECT sensor, satellite, region, season, count(*) AS n FROM obs WHERE kind = 0 AND satellite <> 'Terra' GROUP BY ALL"))
def vegetation_filter(spark, sf_dir):
    return counts.vegetation(observations(spark, sf_dir)).groupBy("sensor", "satellite", "region", "season").agg(F.count("*").alias("n"))


@BOOK.add("outage_antijoin", q(("veg",), "SELECT year, month, count(*) AS n FROM veg WHERE NOT (date BETWEEN '1998-03-10' AND '1998-03-24' OR date BETWEEN '1999-07-01' AND '1999-07-05') GROUP BY ALL"))
def outage_antijoin(spark, sf_dir):
    return counts.without_outages(counts.vegetation(observations(spark, sf_dir)), OUTAGES).groupBy("year", "month").agg(F.count("*").alias("n"))


@BOOK.add("celldays", q(("cd",), "SELECT region, year, count(*) AS n FROM cd GROUP BY ALL"))
def celldays(spark, sf_dir):
    veg = counts.vegetation(observations(spark, sf_dir))
    return counts.cell_days(veg.filter("sensor = 'B'")).groupBy("region", "year").agg(F.count("*").alias("n"))


@BOOK.add("gap_months", q(("obs",), """
SELECT * FROM (SELECT year, month, count(DISTINCT date) FILTER (satellite = 'Terra') AS terra_days, count(DISTINCT date) FILTER (satellite = 'Aqua') AS aqua_days
FROM obs WHERE kind = 0 AND sensor = 'A' AND NOT (satellite = 'Aqua' AND month = 7 AND day(date) > 9) GROUP BY ALL) WHERE terra_days >= 8 AND aqua_days < 0.5 * terra_days"""))
def gap_months(spark, sf_dir):
    obs = observations(spark, sf_dir).filter("not (satellite = 'Aqua' and month = 7 and day(date) > 9)")
    return counts.gap_months(obs)


@BOOK.add("monthly_counts", q(("months",), "SELECT * FROM months"))
def monthly_counts(spark, sf_dir):
    return months(spark, sf_dir)


@BOOK.add("complete_years", q(("obs",), "SELECT year FROM obs GROUP BY year HAVING count(DISTINCT month) = 12"))
def complete_years(spark, sf_dir):
    return counts.complete_years(observations(spark, sf_dir))


@BOOK.add("overpass_drift", q(("obs",), f"""
SELECT year, {r('hour', 'baseline')}, coalesce(abs(hour - baseline) > 0.15, false) AS drifted FROM (
  SELECT *, (SELECT median(h) FROM (SELECT median(h0) AS h FROM (SELECT year, hhmm // 100 + (hhmm % 100) / 60.0e0 + 6 AS h0 FROM obs WHERE satellite = 'Aqua' AND daynight = 'D') WHERE year BETWEEN 1995 AND 1999 GROUP BY year)) AS baseline
  FROM (SELECT year, median(hhmm // 100 + (hhmm % 100) / 60.0e0 + 6) AS hour FROM obs WHERE satellite = 'Aqua' AND daynight = 'D' GROUP BY year))"""))
def overpass_drift(spark, sf_dir):
    return rounded(counts.overpass_drift(observations(spark, sf_dir), (1995, 1999)))


@BOOK.add("ratio_by_group", q(("factors",), f"SELECT region, season, {r('factor')} FROM factors"))
def ratio_by_group(spark, sf_dir):
    return rounded(cal.ratio_by_group(full(spark, sf_dir)))


@BOOK.add("ratio_sets", q(("months",), f"""
SELECT CAST(grouping_id(region, season) AS INT) AS level, region, season, {r('sum(count_a) / greatest(sum(celldays_b), 1) AS factor')}
FROM months WHERE year BETWEEN 1998 AND 2000 GROUP BY GROUPING SETS ((region, season), (region), (season), ())"""))
def ratio_sets(spark, sf_dir):
    return rounded(cal.ratio_sets(full(spark, sf_dir)))


def _method_sql(train: str, test: str) -> str:
    """Predictions of every method, each written out by hand; train and test are conditions on alias t and p."""
    out = [f"SELECT 'naive' AS method, p.year, p.month, p.region, p.season, p.count_a AS actual, CAST(p.raw_b AS DOUBLE) AS pred FROM months p WHERE {test}"]
    out.append(f"SELECT 'climatology', p.year, p.month, p.region, p.season, p.count_a, coalesce((SELECT avg(t.count_a) FROM months t WHERE {train} AND t.region = p.region AND t.month = p.month), 0) FROM months p WHERE {test}")
    for name, col, on in (("global_raw", "raw_b", ""), ("global_celldays", "celldays_b", ""), ("season", "celldays_b", "AND t.season = p.season"), ("region", "celldays_b", "AND t.region = p.region"), ("region_season", "celldays_b", "AND t.region = p.region AND t.season = p.season")):
        out.append(f"SELECT '{name}', p.year, p.month, p.region, p.season, p.count_a, p.{col} * coalesce((SELECT sum(t.count_a) / greatest(sum(t.{col}), 1) FROM months t WHERE {train} {on}), 1) FROM months p WHERE {test}")
    return "\nUNION ALL ".join(out)


part("chrono", ("months",), _method_sql("t.year IN (1998, 1999)", "p.year = 2000"))
part("loyo", ("months",), _method_sql("t.year BETWEEN 1998 AND 2000 AND t.year <> p.year", "p.year BETWEEN 1998 AND 2000"))


@BOOK.add("predict_methods", q(("chrono",), f"SELECT method, year, month, region, season, CAST(actual AS DOUBLE) AS actual, {r('pred')} FROM chrono"))
def predict_methods(spark, sf_dir):
    m = months(spark, sf_dir)
    return rounded(cal.predict(m.filter("year in (1998, 1999)"), m.filter("year = 2000")))


@BOOK.add("loyo", q(("loyo",), f"SELECT method, year, month, region, season, CAST(actual AS DOUBLE) AS actual, {r('pred')} FROM loyo"))
def loyo(spark, sf_dir):
    return rounded(cal.leave_one_year_out(full(spark, sf_dir)))


def _overall_sql(name: str) -> str:
    return f"""
SELECT m.method, {r('mae AS monthly_mae', 'r2 AS monthly_r2', 'bias AS bias_pct', 'reg AS regional_err_pct', 'nat AS national_err_pct')} FROM
 (SELECT method, avg(abs(pred - actual)) AS mae, 1 - sum((pred - actual) ** 2) / sum((actual - mu) ** 2) AS r2, (sum(pred) / sum(actual) - 1) * 100 AS bias
  FROM (SELECT *, avg(actual) OVER (PARTITION BY method) AS mu FROM {name}) GROUP BY method) m
 JOIN (SELECT method, median(abs(p / greatest(t, 1) - 1)) * 100 AS reg FROM (SELECT method, year, region, sum(actual) AS t, sum(pred) AS p FROM {name} GROUP BY ALL) GROUP BY method) a ON m.method = a.method
 JOIN (SELECT method, median(abs(p / greatest(t, 1) - 1)) * 100 AS nat FROM (SELECT method, year, sum(actual) AS t, sum(pred) AS p FROM {name} GROUP BY ALL) GROUP BY method) b ON m.method = b.method"""


@BOOK.add("score_overall", q(("loyo",), _overall_sql("loyo")))
def score_overall(spark, sf_dir):
    return rounded(cal.score_overall(cal.leave_one_year_out(full(spark, sf_dir))))


@BOOK.add("chrono_holdout", q(("chrono",), _overall_sql("chrono")))
def chrono_holdout(spark, sf_dir):
    m = months(spark, sf_dir)
    return rounded(cal.score_overall(cal.predict(m.filter("year in (1998, 1999)"), m.filter("year = 2000"))))


@BOOK.add("score_by_group", q(("loyo",), f"""
SELECT method, region, season, {r('CASE WHEN count(*) > 2 AND stddev_samp(p) > 0 THEN corr(t, p) END AS yearly_r', 'avg(t) AS mean_true', '(sum(p) / sum(t) - 1) * 100 AS bias_pct', 'median(abs(p / greatest(t, 1) - 1)) * 100 AS median_err_pct')}
FROM (SELECT method, region, season, year, sum(actual) AS t, sum(pred) AS p FROM loyo GROUP BY ALL) GROUP BY ALL"""))
def score_by_group(spark, sf_dir):
    return rounded(cal.score_by_group(cal.leave_one_year_out(full(spark, sf_dir))))


@BOOK.add("per_year_ratio", q(("months",), f"SELECT year, region, season, {r('sum(count_a) / greatest(sum(celldays_b), 1) AS factor')} FROM months WHERE year >= 1998 GROUP BY ALL"))
def per_year_ratio(spark, sf_dir):
    return rounded(cal.per_year_ratio(months(spark, sf_dir)))


@BOOK.add("calib_sensitivity", q(("months",), f"""
SELECT subset, region, season, {r('sum(count_a) / greatest(sum(celldays_b), 1) AS factor')}
FROM months JOIN (VALUES ('first', 1998), ('first', 1999), ('all', 1998), ('all', 1999), ('all', 2000), ('all', 2001), ('last', 2001)) v(subset, y) ON year = y GROUP BY ALL"""))
def calib_sensitivity(spark, sf_dir):
    return rounded(cal.sensitivity(months(spark, sf_dir), {"first": [1998, 1999], "all": [1998, 1999, 2000, 2001], "last": [2001]}))


@BOOK.add("harmonize", q(("harm",), f"SELECT year, month, region, {r('harmonized')} FROM harm"))
def harmonize(spark, sf_dir):
    return rounded(harmonized(spark, sf_dir).select("year", "month", "region", "harmonized"))


@BOOK.add("era_stitch", q(("harm",), "SELECT year, region, CAST(sum(naive) AS BIGINT) AS naive FROM harm GROUP BY ALL"))
def era_stitch(spark, sf_dir):
    return cal.naive_stitch(months(spark, sf_dir)).groupBy("year", "region").agg(F.sum("naive").alias("naive"))


@BOOK.add("jump_ratio", q(("harm",), f"""
SELECT {', '.join(r(f"(SELECT avg(v) FROM (SELECT year, sum({c}) AS v FROM harm GROUP BY year) WHERE year BETWEEN 1998 AND 2000) / (SELECT avg(v) FROM (SELECT year, sum({c}) AS v FROM harm GROUP BY year) WHERE year BETWEEN 1995 AND 1997) AS jump_{c}") for c in ('naive', 'harmonized', 'count_a'))}"""))
def jump_ratio(spark, sf_dir):
    return rounded(uncertainty.jump(harmonized(spark, sf_dir), (1995, 1997), (1998, 2000), ["naive", "harmonized", "count_a"]))


@BOOK.add("jump_interval", q(("series",), f"""
SELECT {r('quantile_cont(j, 0.025) AS lo', 'quantile_cont(j, 0.975) AS hi')} FROM (SELECT rep, avg(v) FILTER (year BETWEEN 1998 AND 2000) / avg(v) FILTER (year BETWEEN 1995 AND 1997) AS j FROM (SELECT rep, year, sum(value) AS v FROM series GROUP BY ALL) GROUP BY rep)"""))
def jump_interval(spark, sf_dir):
    return rounded(uncertainty.jump_interval(replicate_series(spark, sf_dir), (1995, 1997), (1998, 2000)))


@BOOK.add("bootstrap_factors", q(("boot",), f"SELECT rep, region, season, {r('factor')} FROM boot"))
def bootstrap_factors(spark, sf_dir):
    m = months(spark, sf_dir)
    return rounded(uncertainty.bootstrap_factors(m, draws(spark)))


@BOOK.add("factor_quantiles", q(("boot",), f"SELECT region, season, {r('quantile_cont(factor, 0.025) AS lo', 'quantile_cont(factor, 0.975) AS hi')} FROM boot GROUP BY ALL"))
def factor_quantiles(spark, sf_dir):
    m = months(spark, sf_dir)
    return rounded(uncertainty.band(uncertainty.bootstrap_factors(m, draws(spark)), ["region", "season"], "factor"))


@BOOK.add("calendar_band", q(("series",), f"SELECT year, month, region, {r('quantile_cont(value, 0.025) AS lo', 'quantile_cont(value, 0.975) AS hi')} FROM series GROUP BY ALL"))
def calendar_band(spark, sf_dir):
    return rounded(uncertainty.band(replicate_series(spark, sf_dir), ["year", "month", "region"]))


@BOOK.add("annual_rollup", q(("harm", "series"), f"""
SELECT a.*, {r('lo', 'hi')} FROM
 (SELECT year, coalesce(region, 'all') AS region, CAST(count(DISTINCT month) AS INT) AS months, CAST(sum(count_a) AS BIGINT) AS count_a, CAST(sum(naive) AS BIGINT) AS naive, bool_or(year = 2001) AS drifted, bool_or(year = 1999 AND month = 7) AS gap, {r('sum(round_even(harmonized, 1)) AS harmonized')} FROM harm GROUP BY GROUPING SETS ((year, region), (year))) a
 JOIN (SELECT year, region, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM
   (SELECT rep, year, coalesce(region, 'all') AS region, sum(value) AS v FROM series GROUP BY GROUPING SETS ((rep, year, region), (rep, year))) GROUP BY year, region) b USING (year, region)"""))
def annual_rollup(spark, sf_dir):
    flagged = harmonized(spark, sf_dir).withColumn("drifted", F.col("year") == 2001).withColumn("gap", (F.col("year") == 1999) & (F.col("month") == 7))
    return rounded(uncertainty.annual_rollup(flagged, replicate_series(spark, sf_dir)))


@BOOK.add("kendall_theilsen", q(("harm",), f"""
SELECT region, n, s, {r('s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau', 'slope')} FROM (
  SELECT a.region, any_value(n) AS n, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, 0 AS tx, count(*) FILTER (a.v = b.v) AS ty, median((b.v - a.v) / (b.year - a.year)) AS slope
  FROM (SELECT *, CAST(count(*) OVER (PARTITION BY region) AS INT) AS n FROM (SELECT region, year, sum(harmonized) AS v FROM harm WHERE year <= 2000 GROUP BY region, year)) a
  JOIN (SELECT region, year, sum(harmonized) AS v FROM harm WHERE year <= 2000 GROUP BY ALL) b ON a.region = b.region AND a.year < b.year GROUP BY a.region)"""))
def kendall_theilsen(spark, sf_dir):
    yearly = harmonized(spark, sf_dir).filter("year <= 2000").groupBy("region", "year").agg(F.sum("harmonized").alias("v"))
    return rounded(stats.kendall_theilsen(yearly, "year", "v", ("region",)))


#: Every order of six years, and how many pairs of it fall: the null distribution of the concordance sum.
part("orders", (), "SELECT (a > b)::INT + (a > c)::INT + (a > d)::INT + (a > e)::INT + (a > f)::INT + (b > c)::INT + (b > d)::INT + (b > e)::INT + (b > f)::INT + (c > d)::INT + (c > e)::INT + (c > f)::INT + (d > e)::INT + (d > f)::INT + (e > f)::INT AS falls FROM range(6) t1(a), range(6) t2(b), range(6) t3(c), range(6) t4(d), range(6) t5(e), range(6) t6(f) WHERE len(list_distinct([a, b, c, d, e, f])) = 6")


@BOOK.add("trend_replicates", q(("series", "orders"), """
SELECT count(*) AS n, avg(CASE WHEN s < 0 AND 2 * (SELECT count(*) FROM orders WHERE falls <= (15 - abs(s)) // 2) / 720 < 0.05 THEN 1.0e0 ELSE 0.0e0 END) AS share FROM (
  SELECT a.rep, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s FROM (SELECT rep, year, sum(value) AS v FROM series WHERE year <= 2000 GROUP BY ALL) a JOIN (SELECT rep, year, sum(value) AS v FROM series WHERE year <= 2000 GROUP BY ALL) b ON a.rep = b.rep AND a.year < b.year GROUP BY a.rep)"""))
def trend_replicates(spark, sf_dir):
    """Share of replicates with a falling trend that an exact test finds at 0.05."""
    yearly = replicate_series(spark, sf_dir).filter("year <= 2000").groupBy("rep", "year").agg(F.sum("value").alias("v"))
    tau = stats.kendall_theilsen(yearly, "year", "v", ("rep",), with_p=True)
    return tau.agg(F.count("*").alias("n"), F.avg(((F.col("tau") < 0) & (F.col("p") < 0.05)).cast("double")).alias("share"))


@BOOK.add("calendar_region", q(("months",), "SELECT year, month, CAST(sum(count_a) AS BIGINT) AS count_a, CAST(sum(raw_b) AS BIGINT) AS raw_b, CAST(sum(celldays_b) AS BIGINT) AS celldays_b FROM months GROUP BY ALL"))
def calendar_region(spark, sf_dir):
    from quillspan.api import calendar

    return calendar(months(spark, sf_dir)).select("year", "month", "count_a", "raw_b", "celldays_b")


@BOOK.add("heat_bins", q(("months",), "SELECT year, month, region, (count_a >= 1)::INT + (count_a >= 10)::INT + (count_a >= 50)::INT + (count_a >= 200)::INT AS heat FROM months"))
def heat_bins(spark, sf_dir):
    return months(spark, sf_dir).select("year", "month", "region", counts.heat_class(F.col("count_a")).alias("heat"))


@BOOK.add("annual_region", q(("harm", "series"), f"""
SELECT year, months, count_a, naive, harmonized, lo, hi FROM (SELECT a.*, {r('lo', 'hi')} FROM
 (SELECT year, CAST(count(DISTINCT month) AS INT) AS months, CAST(sum(count_a) AS BIGINT) AS count_a, CAST(sum(naive) AS BIGINT) AS naive, {r('sum(round_even(harmonized, 1)) AS harmonized')} FROM harm WHERE region = 'plains' GROUP BY year) a
 JOIN (SELECT year, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (SELECT rep, year, sum(value) AS v FROM series WHERE region = 'plains' GROUP BY ALL) GROUP BY year) b USING (year))"""))
def annual_region(spark, sf_dir):
    from quillspan.api import calendar_annual

    return rounded(calendar_annual(uncertainty.annual_rollup(harmonized(spark, sf_dir), replicate_series(spark, sf_dir)), "plains"))


@BOOK.add("archive_read", q(("obs",), f"""
SELECT sensor, satellite, year, month, kind, count(*) AS n, {r('sum(CASE WHEN conf_raw IN (\'l\', \'n\', \'h\') THEN CASE conf_raw WHEN \'l\' THEN 20 WHEN \'n\' THEN 60 ELSE 90 END ELSE coalesce(try_cast(conf_raw AS DOUBLE), 0) END) AS conf')}, CAST(sum(hhmm) AS BIGINT) AS hhmm FROM obs GROUP BY ALL"""))
def archive_read(spark, sf_dir):
    """All detections written as yearly CSV archives of two families, and read back as one table."""
    from quillspan.sources import readers, writers
    from quillspan.staging import scratch_folder

    root = scratch_folder(spark, "archives")
    obs = observations(spark, sf_dir)
    common = ["lat AS latitude", "lon AS longitude", "300.0 AS bright", "1.0 AS scan", "1.0 AS track", "cast(date AS string) AS acq_date", "cast(hhmm AS string) AS acq_time",
              "CASE WHEN satellite = 'S-NPP' THEN 'N' ELSE satellite END AS satellite", "'x' AS instrument", "conf_raw AS confidence", "'1' AS version", "290.0 AS bright_t", "frp", "daynight", "kind AS type"]
    for sensor in ("A", "B"):
        writers.write_csv(obs.filter(F.col("sensor") == sensor).selectExpr(*common), f"{root}/{sensor}")
    raw = readers.read_archive(spark, {"A": ([f"{root}/A"], readers.ARCHIVE_A), "B": ([f"{root}/B", f"{root}/none"], readers.ARCHIVE_B)})
    return rounded(readers.normalise(raw).groupBy("sensor", "satellite", "year", "month", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("conf", F.lit(0.0))).alias("conf"), F.sum("hhmm").alias("hhmm")))
