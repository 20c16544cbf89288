"""Queries over cells: histories, features, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import stats
from quillspan.operators import features as feat
from quillspan.operators import history as hist
from quillspan.operators import ranking as rank
from quillspan.operators.grid import neighbour_mean as mean_of_neighbours
from quillspan.operators.grid import with_cells
from quillspan.plans.adapter import grid, observations, season_observations
from quillspan.plans.base import Book, part, q, r, rounded
from quillspan.plans.calendar import months
from quillspan.staging import staged

BOOK = Book()
YEARS = [1999, 2000, 2001]
BIN = "CASE WHEN k >= 15 THEN 9 WHEN k >= 10 THEN 8 WHEN k >= 8 THEN 7 WHEN k >= 6 THEN 6 ELSE k END"

part("panel", ("hot", "grid"), """
SELECT g.ci, g.cj, CAST(y.year AS INT) AS year, coalesce(n.a, 0) AS count_a, CASE WHEN y.year >= 1998 THEN coalesce(n.b, 0) END AS raw_b, CASE WHEN y.year >= 1998 THEN coalesce(d.n, 0) END AS celldays_b
FROM grid g CROSS JOIN range(1995, 2002) y(year)
LEFT JOIN (SELECT ci, cj, year, count(*) FILTER (sensor = 'A') AS a, count(*) FILTER (sensor = 'B') AS b FROM hot GROUP BY ALL) n ON g.ci = n.ci AND g.cj = n.cj AND y.year = n.year
LEFT JOIN (SELECT ci, cj, year, count(*) AS n FROM (SELECT DISTINCT ci, cj, year, date, fi, fj FROM hot WHERE sensor = 'B') GROUP BY ALL) d ON g.ci = d.ci AND g.cj = d.cj AND y.year = d.year""")
part("binned", ("panel",), f"SELECT *, CAST({BIN} AS INT) AS bin FROM (SELECT *, coalesce(celldays_b, 0) AS k FROM panel)")
part("curve", ("binned",), """
SELECT CAST(b AS INT) AS bin, max(p) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS p FROM range(10) t(b)
LEFT JOIN (SELECT bin, avg(CASE WHEN count_a >= 1 THEN 1.0e0 ELSE 0.0e0 END) AS p FROM binned WHERE year BETWEEN 1998 AND 2000 GROUP BY bin) x ON b = bin""")
part("hbfactor", ("months",), "SELECT sum(count_a) / greatest(sum(celldays_b), 1) AS f FROM months WHERE year BETWEEN 1998 AND 2000 AND region = 'hills' AND season = 'burn'")
part("scored", ("binned", "curve"), "SELECT b.*, c.p, CASE WHEN count_a >= 1 THEN 1.0e0 ELSE 0.0e0 END AS y FROM binned b JOIN curve c ON b.bin = c.bin")
part("flags", ("scored", "hbfactor"), """
SELECT ci, cj, year, round_even(CASE WHEN year < 1998 THEN y ELSE p END, 3) AS active,
  CASE WHEN year < 1998 THEN y WHEN raw_b >= 1 THEN 1.0e0 ELSE 0.0e0 END AS active_naive,
  round_even(CASE WHEN year < 1998 THEN CAST(count_a AS DOUBLE) ELSE celldays_b * f END, 2) AS activity_eq FROM scored CROSS JOIN hbfactor""")
def half_even(value: str, places: int, digits: int = 6) -> str:
    """Rounding half to even in whole numbers: of value at `digits` places, to `places`."""
    unit = 10 ** (digits - places)
    m = f"CAST(round(({value}) * {10**digits}) AS BIGINT)"
    return f"(CASE WHEN 2 * ({m} % {unit}) > {unit} OR (2 * ({m} % {unit}) = {unit} AND ({m} // {unit}) % 2 = 1) THEN {m} // {unit} + 1 ELSE {m} // {unit} END / {10**places}.0e0)"


part("summary", ("flags",), f"""
SELECT *, active_seasons / 7 AS share, CASE WHEN active_before < 0.5 AND active_since >= 0.9 THEN 'new' WHEN active_seasons / 7 >= 0.75 THEN 'chronic' WHEN active_seasons / 7 >= 0.4 THEN 'recurring' WHEN active_seasons / 7 >= 0.15 THEN 'occasional' ELSE 'rare' END AS pattern
FROM (SELECT ci, cj, {half_even('sum(active)', 1)} AS active_seasons, CAST(sum(active_naive) AS INT) AS active_seasons_naive,
  {half_even('sum(CASE WHEN year < 1998 THEN active ELSE 0 END)', 1)} AS active_early, {half_even('sum(CASE WHEN year >= 1998 THEN active ELSE 0 END)', 1)} AS active_late,
  {half_even('sum(CASE WHEN year < 2000 THEN active ELSE 0 END)', 2)} AS active_before, {half_even('sum(CASE WHEN year >= 2000 THEN active ELSE 0 END)', 2)} AS active_since,
  sum(CASE WHEN year >= 1998 THEN active_naive ELSE 0 END) AS naive_late, {half_even('avg(activity_eq)', 2)} AS mean_activity_eq,
  min(year) FILTER (active >= 0.5) AS first_likely, max(year) FILTER (active >= 0.5) AS last_likely,
  CAST(2001 - coalesce(max(year) FILTER (active < 0.5), 1994) AS INT) AS streak FROM flags GROUP BY ci, cj)""")
part("origins", (), "SELECT * FROM (VALUES (1999), (2000), (2001)) o(origin)")
part("ocurve", ("binned", "origins"), """
SELECT origin, CAST(b AS INT) AS bin, max(p) OVER (PARTITION BY origin ORDER BY b ROWS UNBOUNDED PRECEDING) AS p FROM origins CROSS JOIN range(10) t(b)
LEFT JOIN (SELECT o.origin AS oo, bin, avg(CASE WHEN count_a >= 1 THEN 1.0e0 ELSE 0.0e0 END) AS p FROM binned JOIN origins o ON year >= 1998 AND year < o.origin GROUP BY o.origin, bin) x ON b = bin AND origin = oo""")
part("ofactor", ("months", "origins"), "SELECT origin, sum(count_a) / greatest(sum(celldays_b), 1) AS f FROM months JOIN origins ON year >= 1998 AND year < origin WHERE region = 'hills' AND season = 'burn' GROUP BY origin")
part("then_known", ("binned", "ocurve", "ofactor"), """
SELECT c.origin, b.ci, b.cj, b.year, round_even(CASE WHEN year >= 1998 THEN c.p WHEN count_a >= 1 THEN 1.0e0 ELSE 0.0e0 END, 3) AS active,
  CASE WHEN year >= 1998 THEN CAST(raw_b >= 1 AS INT)::DOUBLE WHEN count_a >= 1 THEN 1.0e0 ELSE 0.0e0 END AS active_naive,
  round_even(CASE WHEN year < 1998 THEN CAST(count_a AS DOUBLE) ELSE celldays_b * f END, 2) AS activity_eq
FROM binned b JOIN ocurve c ON b.bin = c.bin JOIN ofactor o ON o.origin = c.origin""")
part("known", ("then_known",), "SELECT origin, ci, cj, avg(active) AS long_share, avg(activity_eq) AS long_activity, avg(active) FILTER (year >= origin - 3) AS long_recent3 FROM then_known WHERE year < origin GROUP BY ALL")
part("days", ("hot",), "SELECT ci, cj, year, CAST(count(DISTINCT date) AS INT) AS days FROM hot WHERE sensor = 'B' GROUP BY ALL")
part("dense", ("days", "grid"), """
SELECT g.*, CAST(y.year AS INT) AS year, CASE WHEN y.year >= 1998 THEN coalesce(d.days, 0) END AS days
FROM grid g CROSS JOIN range(1995, 2002) y(year) LEFT JOIN days d ON d.ci = g.ci AND d.cj = g.cj AND d.year = y.year""")
part("feat0", ("dense", "known"), """
SELECT t.ci, t.cj, t.year, any_value(t.elev_mean) AS elev_mean, any_value(t.slope_mean) AS slope_mean, any_value(t.steep_frac) AS steep_frac, ln(1 + any_value(t.population)) AS log_pop, any_value(t.days) AS days,
  coalesce(max(p.days) FILTER (p.year = t.year - 1), 0) AS lag1_days,
  CAST(coalesce(max(p.days) FILTER (p.year = t.year - 1), 0) > 0 AS INT) AS lag1, CAST(coalesce(max(p.days) FILTER (p.year = t.year - 2), 0) > 0 AS INT) AS lag2, CAST(coalesce(max(p.days) FILTER (p.year = t.year - 3), 0) > 0 AS INT) AS lag3,
  coalesce(avg((p.days > 0)::INT), 0) AS freq, coalesce(avg((p.days >= 3)::INT), 0) AS freq_heavy, coalesce(avg(p.days), 0) AS mean_days,
  coalesce(t.year - max(p.year) FILTER (p.days > 0), 15) AS years_since_burn, coalesce(any_value(k.long_share), 0) AS long_share, coalesce(any_value(k.long_activity), 0) AS long_activity,
  coalesce(any_value(k.long_recent3), 0) AS long_recent3
FROM dense t JOIN dense p ON t.ci = p.ci AND t.cj = p.cj AND p.year < t.year LEFT JOIN known k ON k.ci = t.ci AND k.cj = t.cj AND k.origin = t.year WHERE t.year IN (1999, 2000, 2001) GROUP BY t.ci, t.cj, t.year""")
part("feat", ("feat0",), """
SELECT a.*, coalesce((SELECT sum(b.lag1) FROM feat0 b WHERE b.year = a.year AND abs(b.ci - a.ci) <= 1 AND abs(b.cj - a.cj) <= 1 AND (b.ci <> a.ci OR b.cj <> a.cj)), 0) / 8 AS nbr_lag1,
  coalesce((SELECT sum(b.freq) FROM feat0 b WHERE b.year = a.year AND abs(b.ci - a.ci) <= 1 AND abs(b.cj - a.cj) <= 1 AND (b.ci <> a.ci OR b.cj <> a.cj)), 0) / 8 AS nbr_freq FROM feat0 a""")
part("data", ("feat",), "SELECT *, CAST(coalesce(days, 0) >= 3 AS INT) AS burned, CAST(lag1_days AS DOUBLE) AS s1, freq_heavy + 1e-3 * mean_days AS s2, long_activity AS s3 FROM feat")


def panel(spark, sf_dir):
    return staged(spark, sf_dir, "panel", lambda: hist.season_table(season_observations(spark, sf_dir), grid(spark, sf_dir)))


def clean_curve(p):
    return hist.curve_fit(p.filter("year between 1998 and 2000"))


def scored(spark, sf_dir):
    p = panel(spark, sf_dir)
    return hist.curve_apply(p, clean_curve(p))


def flags(spark, sf_dir):
    def make():
        p = panel(spark, sf_dir)
        rows = months(spark, sf_dir).filter("year between 1998 and 2000 and region = 'hills' and season = 'burn'")
        factor = rows.agg((F.sum("count_a") / F.greatest(F.sum("celldays_b"), F.lit(1))).alias("factor"))
        return hist.cell_flags(p, clean_curve(p), factor)

    return staged(spark, sf_dir, "flags", make)


def known_then(spark, sf_dir):
    """The history as it was known before each target season."""
    return staged(spark, sf_dir, "known_then", lambda: hist.history_as_of(panel(spark, sf_dir), months(spark, sf_dir), YEARS))


def days(spark, sf_dir):
    return staged(spark, sf_dir, "days", lambda: feat.fire_days(season_observations(spark, sf_dir).filter("sensor = 'B'")))


def data(spark, sf_dir):
    return staged(spark, sf_dir, "data", lambda: feat.rule_scores(feat.dataset(grid(spark, sf_dir), days(spark, sf_dir), known_then(spark, sf_dir), YEARS)))


def points(spark, sf_dir):
    return with_cells(season_observations(spark, sf_dir).filter("sensor = 'B'"), 0.02)


def ranking_cells(spark, sf_dir):
    """Cells with fire columns of the last season and a forecast from the seasons before."""
    def make():
        now = rank.per_cell(points(spark, sf_dir).filter("year = 2001"))
        f = data(spark, sf_dir).filter("year = 2001").select("ci", "cj", F.col("score_history").alias("forecast_score"))
        return grid(spark, sf_dir).join(now, ["ci", "cj"], "left").join(f, ["ci", "cj"], "left").fillna(0, ["fire_days", "fire_points"])

    return staged(spark, sf_dir, "ranking_cells", make)


def prioritised(spark, sf_dir):
    return staged(spark, sf_dir, "prioritised", lambda: rank.prioritise(ranking_cells(spark, sf_dir), "observed"))


part("percell", ("hot",), "SELECT ci, cj, count(*) AS fire_points, count(DISTINCT date) AS fire_days, median(slope) AS fire_slope, avg(steep) AS fire_steep_share, avg(people_r1) AS people_r1, avg(people_r2) AS people_r2 FROM hot WHERE sensor = 'B' AND year = 2001 GROUP BY ci, cj")
part("rcells", ("percell", "data", "grid"), "SELECT g.*, coalesce(fire_points, 0) AS fire_points, coalesce(fire_days, 0) AS fire_days, fire_slope, fire_steep_share, people_r1, people_r2, s2 AS forecast_score FROM grid g LEFT JOIN percell USING (ci, cj) LEFT JOIN (SELECT ci, cj, s2 FROM data WHERE year = 2001) USING (ci, cj)")
SLOPE, PEOPLE = "greatest(0, least(1, fire_slope / {s}))", "greatest(0, least(1, ln(1 + CASE WHEN {r} = 1 THEN people_r1 ELSE people_r2 END) / ln(1 + {p})))"


def _score_sql(burn: str, s: str = "25.0e0", rad: str = "1", p: str = "5000.0e0") -> str:
    return f"CASE WHEN fire_slope IS NULL THEN 0.0e0 ELSE {burn} * {SLOPE.format(s=s)} * {PEOPLE.format(r=rad, p=p)} END"


OBSERVED = _score_sql("greatest(0, least(1, fire_days / 3.0e0))")
FORECAST = _score_sql("CASE WHEN lim > 0 THEN greatest(0, least(1, forecast_score / lim)) ELSE 0 END")
part("variants", ("rcells",), f"""
SELECT v, base, ci, cj, row_number() OVER (PARTITION BY v ORDER BY sc DESC, ci DESC, cj) AS place FROM (
  SELECT v, h = 3 AND s = 25 AND p = 5000 AND rad = 1 AS base, ci, cj, {_score_sql('greatest(0, least(1, fire_days / h))', 's', 'rad', 'p')} AS sc
  FROM rcells CROSS JOIN (SELECT row_number() OVER () AS v, * FROM (VALUES (2.0e0), (3.0e0), (4.0e0)) a(h) CROSS JOIN (VALUES (20.0e0), (25.0e0), (30.0e0)) b(s) CROSS JOIN (VALUES (2000.0e0), (5000.0e0), (20000.0e0)) c(p) CROSS JOIN (VALUES (1), (2)) d(rad)) x
) WHERE sc > 0 QUALIFY place <= 50""")
part("robust", ("variants", "rcells"), "SELECT r.ci, r.cj, coalesce(n, 0) / 54 AS robustness FROM rcells r LEFT JOIN (SELECT ci, cj, count(*) AS n FROM variants GROUP BY ci, cj) x ON r.ci = x.ci AND r.cj = x.cj")
part("ranked", ("rcells", "robust"), f"""
SELECT *, CASE WHEN robustness >= 0.8 THEN 'inspect first' WHEN rank <= 150 AND fire_slope >= 15 AND score > 0 THEN 'inspect' WHEN fire_days > 0 THEN 'monitor' ELSE 'none' END AS priority FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, ci DESC, cj) AS INT) AS rank FROM (SELECT c.*, robustness, round_even({OBSERVED}, 4) AS score FROM rcells c JOIN robust USING (ci, cj)))""")


@BOOK.add("season_table", q(("panel",), "SELECT * FROM panel"))
def season_table(spark, sf_dir):
    return panel(spark, sf_dir)


@BOOK.add("curve_fit", q(("curve",), f"SELECT bin, {r('p')} FROM curve"))
def curve_fit(spark, sf_dir):
    return rounded(clean_curve(panel(spark, sf_dir)))


@BOOK.add("cell_flags", q(("flags",), "SELECT * FROM flags"))
def cell_flags(spark, sf_dir):
    return flags(spark, sf_dir)


@BOOK.add("brier_check", q(("scored",), f"SELECT {r('b AS brier', 'a AS share_a', 'm AS share_p', 'a * (1 - a) AS brier_climatology', '1 - b / (a * (1 - a)) AS skill')} FROM (SELECT avg((p - y) ** 2) AS b, avg(y) AS a, avg(p) AS m FROM scored WHERE year = 2001)"))
def brier_check(spark, sf_dir):
    return rounded(hist.brier_check(scored(spark, sf_dir).filter("year = 2001")))


@BOOK.add("reliability", q(("scored",), f"SELECT bin, count(*) AS n, {r('max(p) AS predicted', 'avg(y) AS observed')} FROM scored WHERE year >= 1998 GROUP BY bin"))
def reliability(spark, sf_dir):
    return rounded(hist.reliability(scored(spark, sf_dir).filter("year >= 1998")))


part("sums", ("scored",), "SELECT * FROM (SELECT ci, cj, CAST(sum(y) AS BIGINT) AS y, round(sum(p), 9) AS p FROM scored WHERE year >= 1998 GROUP BY ci, cj) WHERE y > 0 OR p > 0.5")


@BOOK.add("spearman", q(("sums",), f"SELECT {r('corr(ry, rp) AS rho')} FROM (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS rp FROM sums)"))
def spearman(spark, sf_dir):
    sums = hist.per_cell_sums(scored(spark, sf_dir).filter("year >= 1998")).withColumn("p", F.round("p", 9))
    return rounded(stats.spearman(sums, "y", "p"))


SUMMARY = ["active_seasons", "active_early", "active_late", "active_before", "active_since", "mean_activity_eq"]


@BOOK.add("cell_summary", q(("summary",), f"SELECT ci, cj, {r(*SUMMARY)}, active_seasons_naive, first_likely, last_likely, streak, {half_even('share', 3)} AS share_active, pattern, naive_late / 4 - active_early / 3 >= 0.25 AS looks_worse_naive, active_late / 4 - active_early / 3 >= 0.25 AS looks_worse_harmonized FROM summary"))
def cell_summary(spark, sf_dir):
    return rounded(hist.cell_summary(flags(spark, sf_dir)))


@BOOK.add("streak", q(("summary",), "SELECT ci, cj, streak FROM summary"))
def streak(spark, sf_dir):
    return hist.streak(flags(spark, sf_dir), F.col("active") >= 0.5)


@BOOK.add("share_by_year", q(("flags",), f"SELECT year, {r('avg(active) AS harmonized', 'avg(active_naive) AS naive')} FROM flags GROUP BY year"))
def share_by_year(spark, sf_dir):
    return rounded(hist.share_by_year(flags(spark, sf_dir)))


@BOOK.add("pattern_counts", q(("summary",), "SELECT pattern, count(*) AS cells FROM summary GROUP BY pattern"))
def pattern_counts(spark, sf_dir):
    return hist.cell_summary(flags(spark, sf_dir)).groupBy("pattern").agg(F.count("*").alias("cells"))


@BOOK.add("history_as_of", q(("then_known",), "SELECT * FROM then_known"))
def history_as_of(spark, sf_dir):
    return known_then(spark, sf_dir)


@BOOK.add("fire_days", q(("days",), "SELECT * FROM days"))
def fire_days(spark, sf_dir):
    return days(spark, sf_dir)


@BOOK.add("neighbour_mean", q(("grid",), "SELECT a.ci, a.cj, (SELECT coalesce(sum(b.population), 0) FROM grid b WHERE abs(b.ci - a.ci) <= 1 AND abs(b.cj - a.cj) <= 1 AND (b.ci <> a.ci OR b.cj <> a.cj)) / 8 AS m FROM grid a"))
def neighbour_mean(spark, sf_dir):
    return mean_of_neighbours(grid(spark, sf_dir), "population", "m").select("ci", "cj", "m")


FLOATS = ["elev_mean", "slope_mean", "steep_frac", "log_pop", "freq", "freq_heavy", "mean_days", "long_share", "long_activity", "long_recent3", "nbr_lag1", "nbr_freq"]


@BOOK.add("features", q(("feat",), f"SELECT ci, cj, year, days, lag1_days, lag1, lag2, lag3, years_since_burn, {r(*FLOATS)} FROM feat"))
def features(spark, sf_dir):
    return rounded(feat.features(grid(spark, sf_dir), days(spark, sf_dir), known_then(spark, sf_dir), YEARS))


@BOOK.add("dataset", q(("data",), f"SELECT ci, cj, year, burned, lag1_days, lag1, lag2, lag3, years_since_burn, {r(*FLOATS)} FROM data"))
def dataset(spark, sf_dir):
    return rounded(feat.dataset(grid(spark, sf_dir), days(spark, sf_dir), known_then(spark, sf_dir), YEARS))


@BOOK.add("scorers", q(("data",), f"SELECT ci, cj, year, {r('s1 AS score_last_year', 's2 AS score_history', 's3 AS score_long_history')} FROM data"))
def scorers(spark, sf_dir):
    return rounded(data(spark, sf_dir).select("ci", "cj", "year", "score_last_year", "score_history", "score_long_history"))


part("tiers", ("data",), "SELECT year, s, count(*) AS n, sum(burned) AS h, sum(count(*)) OVER w - count(*) AS n0, sum(sum(burned)) OVER w - sum(burned) AS h0 FROM (SELECT year, burned, round(s2, 9) AS s FROM data) GROUP BY year, s WINDOW w AS (PARTITION BY year ORDER BY s DESC ROWS UNBOUNDED PRECEDING)")


def _judged(spark, sf_dir):
    return data(spark, sf_dir).withColumn("s", F.round("score_history", 9))


@BOOK.add("precision_at_k", q(("tiers",), f"SELECT year, {r('sum(h / n * greatest(0, least(n, 50 - n0))) / 50 AS precision')} FROM tiers GROUP BY year"))
def precision_at_k(spark, sf_dir):
    return rounded(rank.precision_at_k(_judged(spark, sf_dir), "s", "burned", 50, ("year",)))


@BOOK.add("avg_precision", q(("tiers",), f"SELECT year, {r('sum(h * (h0 + h) / (n0 + n)) / nullif(sum(h), 0) AS avg_precision')} FROM tiers GROUP BY year"))
def avg_precision(spark, sf_dir):
    return rounded(rank.average_precision(_judged(spark, sf_dir), "s", "burned", ("year",)))


@BOOK.add("roc_auc", q(("data",), f"SELECT year, {r('(sum(rk) FILTER (burned = 1) - sum(burned) * (sum(burned) + 1) / 2.0e0) / nullif(sum(burned) * (count(*) - sum(burned)), 0) AS auc')} FROM (SELECT year, burned, rank() OVER (PARTITION BY year ORDER BY round(s2, 9)) + (count(*) OVER (PARTITION BY year, round(s2, 9)) - 1) / 2.0e0 AS rk FROM data) GROUP BY year"))
def roc_auc(spark, sf_dir):
    return rounded(rank.roc_auc(_judged(spark, sf_dir), "s", "burned", ("year",)))


METHODS = {"last_year": "score_last_year", "history": "score_history", "long_history": "score_long_history"}
part("long", ("data",), "SELECT 'last_year' AS method, year, burned AS y, round(s1, 9) AS s FROM data UNION ALL SELECT 'history', year, burned, round(s2, 9) FROM data UNION ALL SELECT 'long_history', year, burned, round(s3, 9) FROM data")
part("ltiers", ("long",), "SELECT method, year, s, count(*) AS n, sum(y) AS h, sum(count(*)) OVER w - count(*) AS n0, sum(sum(y)) OVER w - sum(y) AS h0 FROM long GROUP BY method, year, s WINDOW w AS (PARTITION BY method, year ORDER BY s DESC ROWS UNBOUNDED PRECEDING)")
part("judged", ("ltiers",), """
SELECT method, year, sum(h * (h0 + h) / (n0 + n)) / nullif(sum(h), 0) AS avg_precision, sum(h / n * greatest(0, least(n, 20 - n0))) / 20 AS p20, sum(h / n * greatest(0, least(n, 50 - n0))) / 50 AS p50, sum(h) / sum(n) AS base_rate FROM ltiers GROUP BY method, year""")


def judged(spark, sf_dir):
    def make():
        d = data(spark, sf_dir)
        for c in METHODS.values():
            d = d.withColumn(c, F.round(c, 9))
        return rank.rolling_origin(d, METHODS, ks=(20, 50))

    return staged(spark, sf_dir, "judged", make)


@BOOK.add("rolling_origin", q(("judged",), f"SELECT method, year, {r('avg_precision', 'p20', 'p50', 'base_rate')} FROM judged"))
def rolling_origin(spark, sf_dir):
    return rounded(judged(spark, sf_dir).drop("auc"))


@BOOK.add("method_summary", q(("judged",), f"SELECT method, {r('avg(p50) AS p50_mean', 'min(p50) AS p50_min', 'max(p50) AS p50_max', 'avg(avg_precision) AS avg_precision_mean', 'min(avg_precision) AS avg_precision_min', 'max(avg_precision) AS avg_precision_max')} FROM judged GROUP BY method"))
def method_summary(spark, sf_dir):
    return rounded(rank.over_seasons(judged(spark, sf_dir), ["p50", "avg_precision"]))


@BOOK.add("base_rate", q(("data",), f"SELECT year, {r('avg(burned) AS rate')} FROM data GROUP BY year"))
def base_rate(spark, sf_dir):
    return rounded(data(spark, sf_dir).groupBy("year").agg(F.avg("burned").alias("rate")))


part("means", ("judged",), "SELECT method, round(avg(p50), 9) AS p, round(avg(avg_precision), 9) AS a FROM judged GROUP BY method")


@BOOK.add("choose_default", q(("means",), "SELECT coalesce(arg_min(method, list_position(['last_year', 'history', 'long_history'], method)), 'boosted') AS chosen FROM means WHERE p >= (SELECT max(p) FROM means) - 0.02 AND a >= (SELECT max(a) FROM means) - 0.02"))
def choose_default(spark, sf_dir):
    means = judged(spark, sf_dir).groupBy("method").agg(F.round(F.avg("p50"), 9).alias("p50"), F.round(F.avg("avg_precision"), 9).alias("ap"))
    return rank.choose_default(means, list(METHODS))


PER_CELL = ["fire_slope", "fire_steep_share", "people_r1", "people_r2"]


@BOOK.add("per_cell", q(("percell",), f"SELECT ci, cj, fire_points, fire_days, {r(*PER_CELL)} FROM percell"))
def per_cell(spark, sf_dir):
    return rounded(rank.per_cell(points(spark, sf_dir).filter("year = 2001")))


@BOOK.add("score_observed", q(("rcells",), f"SELECT ci, cj, {r(OBSERVED + ' AS score')} FROM rcells"))
def score_observed(spark, sf_dir):
    return rounded(rank.scored(ranking_cells(spark, sf_dir), "observed", [rank.DEFAULT]).select("ci", "cj", "score"))


@BOOK.add("score_forecast", q(("rcells",), f"SELECT ci, cj, {r(FORECAST + ' AS score')} FROM rcells CROSS JOIN (SELECT quantile_cont(forecast_score, 0.95) AS lim FROM rcells)"))
def score_forecast(spark, sf_dir):
    return rounded(rank.scored(ranking_cells(spark, sf_dir), "forecast", [rank.DEFAULT]).select("ci", "cj", "score"))


@BOOK.add("robustness", q(("robust",), f"SELECT ci, cj, {r('robustness')} FROM robust"))
def robustness(spark, sf_dir):
    return rounded(rank.robustness(ranking_cells(spark, sf_dir), "observed"))


@BOOK.add("top_overlap", q(("variants",), f"""
SELECT CAST(count(*) AS INT) AS n, {r('min(j) AS lowest', 'median(j) AS middle')} FROM (
  SELECT v, count(d.ci) / (count(*) + (SELECT count(*) FROM variants WHERE base) - count(d.ci)) AS j FROM variants a LEFT JOIN (SELECT ci, cj FROM variants WHERE base) d ON a.ci = d.ci AND a.cj = d.cj GROUP BY v)"""))
def top_overlap(spark, sf_dir):
    j = rank.top_overlap(ranking_cells(spark, sf_dir), "observed")
    return rounded(j.agg(F.count("*").cast("int").alias("n"), F.min("jaccard").alias("lowest"), F.median("jaccard").alias("middle")))


ACTION = "CASE priority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rank.ACTIONS.items()) + " END"


@BOOK.add("prioritise", q(("ranked",), f"SELECT ci, cj, {r('score', 'robustness')}, rank, priority, {ACTION} AS action FROM ranked"))
def prioritise(spark, sf_dir):
    return rounded(prioritised(spark, sf_dir).select("ci", "cj", "score", "robustness", "rank", "priority", "action"))


@BOOK.add("priority_counts", q(("ranked",), "SELECT priority, count(*) AS cells FROM ranked GROUP BY priority"))
def priority_counts(spark, sf_dir):
    return prioritised(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("cells"))


@BOOK.add("district_rollup", q(("ranked",), f"SELECT district, count(*) AS cells, count(*) FILTER (priority = 'inspect first') AS inspect_first, count(*) FILTER (priority = 'inspect') AS inspect, count(*) FILTER (priority = 'monitor') AS monitor, {r('max(score) AS max_score')} FROM ranked GROUP BY district"))
def district_rollup(spark, sf_dir):
    from quillspan.api import district_rollup as rollup

    return rounded(rollup(prioritised(spark, sf_dir)))


@BOOK.add("watchlist", q(("ranked", "summary"), f"SELECT 'observed' AS kind, rank, priority, {r('score', 'robustness', 'fire_slope')}, fire_days, pattern, streak, ci, cj FROM ranked LEFT JOIN summary USING (ci, cj)"))
def watchlist(spark, sf_dir):
    ranked = prioritised(spark, sf_dir).join(hist.cell_summary(flags(spark, sf_dir)).select("ci", "cj", "pattern", "streak"), ["ci", "cj"], "left")
    return rounded(ranked.select(F.lit("observed").alias("kind"), "rank", "priority", "score", "robustness", "fire_slope", "fire_days", "pattern", "streak", "ci", "cj"))


@BOOK.add("coincidence", q(("rcells",), "SELECT count(*) AS burned, count(*) FILTER (slope_mean >= 15) AS steep_cell, count(*) FILTER (fire_slope >= 15) AS steep_fire, count(*) FILTER (slope_mean >= 15 AND fire_slope >= 15) AS steep_both, count(*) FILTER (people_cell >= 500) AS people_cell, count(*) FILTER (people_r1 >= 500) AS people_fire, count(*) FILTER (people_cell >= 500 AND people_r1 >= 500) AS people_both FROM rcells WHERE fire_days > 0"))
def coincidence(spark, sf_dir):
    return rank.coincidence(ranking_cells(spark, sf_dir))


part("bt", ("hot", "days", "grid"), f"""
SELECT o.origin, g.ci, g.cj, fire_slope, people_r1, people_r2, coalesce(f, 0) AS forecast_score, coalesce(heavy, 0) AS heavy, coalesce(steep, 0) AS steep, coalesce(sp, 0) AS steep_people
FROM grid g CROSS JOIN (VALUES (2000), (2001)) o(origin)
LEFT JOIN (SELECT origin, ci, cj, median(slope) AS fire_slope, avg(people_r1) AS people_r1, avg(people_r2) AS people_r2 FROM hot JOIN (VALUES (2000), (2001)) v(origin) ON year < origin WHERE sensor = 'B' GROUP BY ALL) b ON b.origin = o.origin AND b.ci = g.ci AND b.cj = g.cj
LEFT JOIN (SELECT origin, ci, cj, round(count(*) FILTER (days >= 3) / (origin - 1998) + 1e-3 * sum(days) / (origin - 1998), 9) AS f FROM days JOIN (VALUES (2000), (2001)) v(origin) ON year < origin GROUP BY origin, ci, cj) c ON c.origin = o.origin AND c.ci = g.ci AND c.cj = g.cj
LEFT JOIN (SELECT year, ci, cj, CAST(count(DISTINCT date) >= 3 AS INT) AS heavy, CAST(count(DISTINCT date) >= 3 AND median(slope) >= 15 AS INT) AS steep, CAST(count(DISTINCT date) >= 3 AND median(slope) >= 15 AND avg(people_r1) >= 200 AS INT) AS sp FROM hot WHERE sensor = 'B' GROUP BY ALL) d ON d.year = o.origin AND d.ci = g.ci AND d.cj = g.cj""")


@BOOK.add("backtest", q(("bt",), f"""
SELECT origin, ranking, outcome, {r('sum(h / n * greatest(0, least(n, 50 - n0))) AS hits')} FROM (
  SELECT origin, ranking, outcome, s, count(*) AS n, sum(hit) AS h, sum(count(*)) OVER (PARTITION BY origin, ranking, outcome ORDER BY s DESC ROWS UNBOUNDED PRECEDING) - count(*) AS n0
  FROM (SELECT origin, ranking, outcome, round(CASE ranking WHEN 'whole' THEN w WHEN 'forecast' THEN forecast_score ELSE sp END, 9) AS s, CASE outcome WHEN 'heavy' THEN heavy WHEN 'steep' THEN steep ELSE steep_people END AS hit
    FROM (SELECT b.*, {FORECAST} AS w, {_score_sql('1.0e0')} AS sp FROM bt b JOIN (SELECT origin, quantile_cont(forecast_score, 0.95) AS lim FROM bt GROUP BY origin) USING (origin))
    CROSS JOIN (VALUES ('whole'), ('forecast'), ('slope_people')) a(ranking) CROSS JOIN (VALUES ('heavy'), ('steep'), ('steep_people')) c(outcome))
  GROUP BY origin, ranking, outcome, s) GROUP BY origin, ranking, outcome"""))
def backtest(spark, sf_dir):
    return rounded(rank.backtest(points(spark, sf_dir), grid(spark, sf_dir), days(spark, sf_dir), [2000, 2001], 1998))


@BOOK.add("gbm_scores")
def gbm_scores(spark, sf_dir):
    d = data(spark, sf_dir)
    return feat.boosted_scores(d.filter("year < 2001"), d.filter("year = 2001")).select("ci", "cj", "burned", "score_boosted")


@BOOK.add("chance", q(("bt",), f"SELECT origin, outcome, {r('avg(hit) AS base_rate', 'avg(hit) * 50 AS expected')} FROM (SELECT origin, unnest(['heavy', 'steep', 'steep_people']) AS outcome, unnest([heavy, steep, steep_people]) AS hit FROM bt) GROUP BY ALL"))
def chance(spark, sf_dir):
    return rounded(rank.chance(points(spark, sf_dir), grid(spark, sf_dir), [2000, 2001]))


@BOOK.add("robustness_summary", q(("variants", "robust"), f"""
SELECT o.*, (SELECT count(*) FROM robust JOIN (SELECT DISTINCT ci, cj FROM variants WHERE base) USING (ci, cj) WHERE robustness >= 0.8) AS default_top_robust, (SELECT count(*) FROM robust WHERE robustness >= 0.8) AS robust_anywhere FROM (
  SELECT count(*) AS variants, {r('median(j) AS jaccard_median', 'min(j) AS jaccard_min')} FROM (
  SELECT v, count(d.ci) / (count(*) + (SELECT count(*) FROM variants WHERE base) - count(d.ci)) AS j FROM variants a LEFT JOIN (SELECT ci, cj FROM variants WHERE base) d ON a.ci = d.ci AND a.cj = d.cj GROUP BY v)) o"""))
def robustness_summary(spark, sf_dir):
    return rounded(rank.robustness_summary(ranking_cells(spark, sf_dir), "observed"))


@BOOK.add("seeded_sample", q(("grid",), "SELECT ci, cj FROM grid ORDER BY md5('7|' || ci || '|' || cj) LIMIT 20"))
def seeded_sample(spark, sf_dir):
    return rank.seeded_sample(grid(spark, sf_dir), 20, 7, ["ci", "cj"]).select("ci", "cj")


@BOOK.add("blind_codes", q(("grid",), "SELECT ci, cj, 'P' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS code FROM (SELECT ci, cj, row_number() OVER (ORDER BY md5('7|' || ci || '|' || cj)) AS n FROM grid)"))
def blind_codes(spark, sf_dir):
    return rank.blind_codes(grid(spark, sf_dir).select("ci", "cj"), 7, ["ci", "cj"])


@BOOK.add("set_equality", q(("grid",), "SELECT 0::BIGINT AS only_a, count(*) AS only_b, false AS equal FROM (SELECT DISTINCT ci, cj FROM grid WHERE ci >= 1052 EXCEPT SELECT ci, cj FROM grid WHERE ci >= 1053)"))
def set_equality(spark, sf_dir):
    cells = grid(spark, sf_dir).select("ci", "cj")
    return rank.same_rows(cells.filter("ci >= 1053"), cells.filter("ci >= 1052"))


@BOOK.add("fires_filter", q(("obs",), f"SELECT id, date, {r('lat', 'lon', 'frp')} FROM obs WHERE year = 1999 AND month = 3 AND kind = 0 AND sensor = 'B' AND region = 'hills' ORDER BY date, id LIMIT 100"))
def fires_filter(spark, sf_dir):
    from quillspan.api import fires

    return rounded(fires(observations(spark, sf_dir), 1999, 3, "B", True, 100).select("id", "date", "lat", "lon", "frp"))


@BOOK.add("cell_lookup", q(("flags",), "SELECT year, active, active_naive, activity_eq FROM flags WHERE ci = floor(21.05 / 0.02) AND cj = floor(92.05 / 0.02)"))
def cell_lookup(spark, sf_dir):
    from quillspan.api import cell_history

    return cell_history(flags(spark, sf_dir), 21.05, 92.05).select("year", "active", "active_naive", "activity_eq")


def _listed(spark, sf_dir):
    return prioritised(spark, sf_dir).withColumn("kind", F.lit("observed"))


@BOOK.add("watchlist_top", q(("ranked",), f"SELECT ci, cj, rank, {r('score')} FROM ranked WHERE priority = 'inspect' AND district = 'd2' ORDER BY rank LIMIT 20"))
def watchlist_top(spark, sf_dir):
    from quillspan.api import watchlist as top

    return rounded(top(_listed(spark, sf_dir), "observed", "inspect", "D2", 20).select("ci", "cj", "rank", "score"))


@BOOK.add("map_rows", q(("ranked",), "SELECT ci, cj, priority FROM ranked WHERE priority <> 'none'"))
def map_rows(spark, sf_dir):
    from quillspan.api import map_rows as rows

    return rows(_listed(spark, sf_dir)).select("ci", "cj", "priority")


@BOOK.add("grid_rows", q(("grid",), "SELECT slope_mean, population, people_cell, elev_mean, round_even(steep_frac, 3) AS steep_frac, district FROM grid"))
def grid_rows(spark, sf_dir):
    from quillspan.api import grid_rows as rows

    return rows(grid(spark, sf_dir))


@BOOK.add("history_share", q(("flags",), "SELECT year, round_even(round(avg(active), 9), 3) AS harmonized, round_even(round(avg(active_naive), 9), 3) AS naive FROM flags GROUP BY year"))
def history_share(spark, sf_dir):
    from quillspan.api import history_share as share

    return share(flags(spark, sf_dir))


@BOOK.add("cell_bounds", q(("grid",), f"SELECT ci, cj, {r('cj * 0.02e0 AS west', 'ci * 0.02e0 AS south', '(cj + 1) * 0.02e0 AS east', '(ci + 1) * 0.02e0 AS north')} FROM grid"))
def cell_bounds(spark, sf_dir):
    from quillspan.operators.grid import bounds

    sides = zip(bounds("ci", "cj", 0.02), ("west", "south", "east", "north"), strict=True)
    return rounded(grid(spark, sf_dir).select("ci", "cj", *(c.alias(n) for c, n in sides)))
