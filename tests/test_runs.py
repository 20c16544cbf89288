"""A whole run on the driver's small tables."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspan import api, runs
from quillspan.config import CONFIG
from quillspan.operators import ranking, spatial
from quillspan.operators.grid import centre
from quillspan.plans import adapter
from quillspan.plans.places import places

SF = "/root/testdata/sf0.001"


def whole_grid(spark):
    """Every cell of the area, also those without detections in the smallest tables."""
    cells = spark.range(400).select(F.floor(1050 + F.col("id") / 20).cast("long").alias("ci"), (4600 + F.col("id") % 20).alias("cj"))
    return adapter.terrain(cells)


def images(spark):
    """Two cells with two windows of six scenes of 100 pixels."""
    base = spark.range(2).select(F.col("id").alias("cell"), F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("window"))
    base = base.withColumn("scene", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(99))))
    c, s, p = F.col("cell"), F.col("scene"), F.col("p")
    return base.select(
        "cell", "window", "scene", s.alias("place"), F.floor(p / 10).cast("long").alias("row"), (p % 10).cast("long").alias("col"),
        ((c * 31 + s * 17 + p * 7) % 100 + 20 + F.when(F.col("window") == "pre", 60).otherwise(0)).cast("double").alias("nir"), ((c * 13 + s * 29 + p * 3) % 90 + 10).cast("double").alias("swir"),
        F.when((p + s * 3 + c) % 20 < s % 4 * 3, 9).otherwise(4).alias("scl"))
YEARS = [1998, 1999, 2000]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    run = runs.Run(spark, str(tmp_path_factory.mktemp("run")), replace(CONFIG, replicates=50))
    obs = run.write("detections", lambda: adapter.observations(spark, SF))
    grid = whole_grid(spark).withColumn("lat", centre("ci", 0.02)).withColumn("lon", centre("cj", 0.02)).withColumn("slope_p90", F.col("slope_mean") + 5)
    return run, obs, run.write("grid", lambda: grid)


def test_whole_run(spark, world):
    run, obs, grid = world
    out = runs.harmonize(run, obs, YEARS, [("1999-03-01", "1999-03-05")])
    cal = out["calendar"]
    assert cal.count() == 2 * (12 * (2001 - 1995) + 11)
    assert cal.filter("year < 1998 and raw_b is not null").count() == 0
    assert cal.filter("year >= 1998 and not (lo <= hi)").count() == 0
    assert out["calendar_annual"].count() == 21 and out["loyo_scores"].count() == 7
    built = runs.build_history(run, obs, grid, YEARS)
    assert built["cell_history"].groupBy("ci", "cj").count().filter("count != 7").count() == 0
    assert built["cell_history"].filter("year < 1998 and active != active_naive").count() == 0
    f = runs.forecast(run, obs, grid, YEARS, [2000, 2001], 2002, rounds=3)
    assert f["rolling_origin"].count() == 8 and f["forecast"].count() == 400
    model = run.tables.report("model")
    means = {r["method"]: (r["p50_mean"], r["avg_precision_mean"]) for r in model["summary"]}
    best = [max(v[k] for v in means.values()) for k in (0, 1)]
    assert model["chosen"] == next(m for m in [*runs.METHODS, "boosted"] if all(means[m][k] >= best[k] - 0.02 for k in (0, 1)))
    assert f["forecast"].filter(F.col("forecast_score") != F.col(runs.METHODS[model["chosen"]])).count() == 0

    pts = adapter.season_observations(spark, SF)
    lists = runs.watchlist(run, pts, grid, places(spark), 2001, [2000, 2001])
    assert lists.count() == 800
    assert lists.filter("priority = 'inspect first' and robustness < 0.8").count() == 0
    assert lists.filter(F.col("action") != ranking.action(F.col("priority"))).count() == 0
    assert api.map_rows(lists).filter("priority = 'none'").count() == 0
    assert {"calendar", "watchlist", "forecast"} <= set(run.tables.health()) and run.seconds["watchlist"] >= 0
    top = api.watchlist(lists, limit=5).select("score").collect()
    assert [r.score for r in top] == sorted((r.score for r in top), reverse=True)
    assert lists.filter(F.col("km").isNull()).count() == 0

    page = api.cell_page(run.tables, 21.05, 92.05)
    assert page["cell"].count() == page["history_summary"].count() == page["forecast_scores"].count() == 1
    assert page["history"].count() == 7 and page["watchlist"].count() == 2 and len(page["forecast_scores"].columns) == 4
    with pytest.raises(api.OutsideGrid):
        api.cell_page(run.tables, 0.0, 0.0)

    whole = api.summary(run.tables)
    assert whole["data_end"] == str(obs.agg(F.max("date")).first()[0]) and whole["imagery"] is None
    assert whole["jump"]["lo"] <= whole["jump"]["hi"] and whole["chronological_holdout"]["naive"]["method"] == "naive"
    assert {r["kind"] for r in whole["watchlist"]["robustness"]} == {"observed", "forecast"} and len(whole["watchlist"]["backtest"]) == 18
    assert set(api.validation(run.tables)) == set(api.REPORTS)
    assert [r.year for r in api.history_share(run.tables.table("cell_history")).collect()] == list(range(1995, 2002))

    # The watch and the images on top of the same tables.
    days = obs.filter("sensor = 'B' and date <= date'2001-03-15'")
    doc = runs.live(run, days, grid.drop("district", "people_cell", "elev_mean", "steep_frac", "slope_p90"), places(spark), days, [2000, 2001], "a file", "2001-03-15")
    assert doc == json.loads(open(f"{run.root}/live.json").read()) and doc["counts"]["to"] == "2001-03-15" and doc["counts"]["fires"] == len(doc["fires"])
    cells = [f"{r.ci}_{r.cj}" for r in lists.filter("kind = 'observed'").select("ci", "cj").collect()]
    pixels = images(spark).join(spark.createDataFrame([(c, i % 2) for i, c in enumerate(cells)], "name string, cell long"), "cell").drop("cell").withColumnRenamed("name", "cell")
    report = runs.check_imagery(run, pixels, 5, 3, 100, [4], 2001)
    assert report["current"] is True and sum(r["cells"] for r in report["groups"]) == run.tables.table("image_sample").count()
    again = runs.check_imagery(run, None, 5, 3, 100, [4], 2001)
    assert again == report == api.summary(run.tables)["imagery"]


def test_rolling_origin_knows_no_later_season(spark, tmp_path):
    """All of 2001 turned upside down changes nothing that 2000 is judged by."""
    obs = adapter.observations(spark, SF)
    got = []
    for later in (obs, obs.filter("year < 2001")):
        run = runs.Run(spark, str(tmp_path / str(len(got))), replace(CONFIG, replicates=5))
        runs.harmonize(run, later, [1998, 1999, 2000])
        grid = whole_grid(spark)
        runs.build_history(run, later, grid, [1998, 1999, 2000])
        judged = runs.forecast(run, later, grid, [1998, 1999, 2000, 2001], [2000], 2001, rounds=2)["rolling_origin"]
        got.append(sorted(map(tuple, judged.filter("year = 2000").collect())))
    assert got[0] == got[1] and len(got[0]) == 4


def test_grid_build_and_fire_points(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path))
    zoom, x0, y0 = 9, 387, 225  # two tiles side by side, a pixel is about 300 m
    px = spark.range(2 * 256 * 256).select((F.floor(F.col("id") / 65536) + x0).alias("tx"), F.lit(y0).alias("ty"), F.floor(F.col("id") % 65536 / 256).alias("r"), (F.col("id") % 256).alias("c"))
    tiles = px.withColumn("value", ((F.col("tx") - x0) * 256 + F.col("c")).cast("double") * 100)  # rises evenly to the east
    slopes = runs.slope_raster(run, tiles, zoom, x0, y0)
    corner = slopes.select(F.max(spatial.pixel_lat(F.col("row"), y0, zoom)).alias("n"), F.min(spatial.pixel_lon(F.col("col"), x0, zoom)).alias("w")).first()
    square = [[corner.w + a, corner.n - b] for a, b in ((0.1, 0.1), (0.5, 0.1), (0.5, 0.4), (0.1, 0.4), (0.1, 0.1))]
    edges = spatial.edges_of(spark.createDataFrame([(7, [square])], "poly_id int, rings array<array<array<double>>>"))
    names = spark.createDataFrame([(7, "hills"), (8, "sea")], "poly_id int, name string")
    people = spark.range(900).select((corner.n - (F.floor(F.col("id") / 30) + 0.5) * 0.02).alias("lat"), (corner.w + (F.col("id") % 30 + 0.5) * 0.02).alias("lon"), F.lit(2.0).alias("value"))
    grid = runs.build_grid(run, slopes, people, edges, names, zoom, x0, y0, ["hills"])
    rows = grid.collect()
    assert 250 <= len(rows) <= 340 and {r.district for r in rows} == {"hills"}
    assert all(corner.w + 0.1 <= r.lon <= corner.w + 0.5 and corner.n - 0.4 <= r.lat <= corner.n - 0.1 for r in rows)
    width = F.cos(F.radians(F.lit(float(rows[0].lat)))) * (156543.03392 / 2**zoom)
    expected = spark.range(1).select(F.degrees(F.atan(100 / width)).alias("s")).first().s
    assert abs(rows[0].slope_mean - expected) < 0.1 and sum(r.population for r in rows) >= 2.0 * len(rows) * 0.8
    at = rows[len(rows) // 2]
    hits = spark.createDataFrame([(1, at.lat, at.lon), (2, at.lat, at.lon), (3, 0.0, 0.0)], "id long, lat double, lon double")
    obs = hits.select("*", F.lit("B").alias("sensor"), F.lit("N").alias("satellite"), F.lit(0).alias("kind"), F.lit("hills").alias("region"), F.lit(3).alias("month"), F.lit(2001).alias("year"), F.lit(9.0).alias("slope"), F.lit(9.0).alias("steep"), F.lit(9.0).alias("people_r1"), F.lit(9.0).alias("people_r2"))
    raster = spark.range(900).select(F.floor(F.col("id") / 30).alias("row"), (F.col("id") % 30).alias("col"), F.lit(2.0).alias("value"))
    pts = runs.fire_points(run, obs, grid, slopes, raster, zoom, x0, y0, (corner.n, corner.w, 0.02), 1200.0).collect()
    assert sorted(r.id for r in pts) == [1, 2] and all((r.people_r1, r.people_r2) == (18.0, 50.0) for r in pts)
    assert all(abs(r.slope - expected) < 0.2 and r.steep == float(expected >= 15) for r in pts)
