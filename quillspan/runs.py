"""Whole runs: from detections and a grid to the written tables that quillspan.api serves.

Every step reads what the steps before have written, so a failed run resumes
at its step and nothing is worked out twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.api import Tables
from quillspan.config import CONFIG, Config
from quillspan.functions import stats
from quillspan.operators import calibration, counts, features, history, imagery, ranking, spatial, uncertainty
from quillspan.operators import live as watch
from quillspan.operators.grid import centre, members, neighbour_mean, with_cells
from quillspan.operators.spatial import tag_polygons
from quillspan.sources.readers import fetch_days, last_day, normalise, raster_position, read_availability, read_live
from quillspan.sources.writers import as_arrays, as_json, refresh_years, report, save_model, stale_years, watermark, write_csv, write_table, write_text
from quillspan.staging import Stages, drop_folders, folder_values, numbered_folders
from quillspan.streaming.watch import DAY_OUT, cell_days, run_available


@dataclass
class Run:
    """A folder of tables, and how long its steps took."""

    spark: SparkSession
    root: str
    cfg: Config = CONFIG
    seconds: dict[str, float] = field(default_factory=dict)

    def kept(self, name: str, make: Callable[[], DataFrame], reads: tuple[str, ...]) -> DataFrame:
        """A table that stays from run to run, until one of the files and folders it reads changes or one is added."""
        return Stages(self.spark, f"{self.root}/kept", manifest=True).table(name, make, reads)

    @property
    def tables(self) -> Tables:
        return Tables(self.spark, self.root)

    def write(self, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        began = time.perf_counter()
        write_table(make(), f"{self.root}/{name}", by)
        self.seconds[name] = round(time.perf_counter() - began, 1)
        return self.tables.table(name)

    def report(self, name: str, frames: dict[str, DataFrame], shape: dict[str, Callable] | None = None, more: dict | None = None) -> dict:
        """Write small tables as name_report.json; shape turns a table's rows into what the report shows."""
        out = report(frames)
        out = {k: (shape or {}).get(k, lambda rows: rows)(rows) for k, rows in out.items()} | (more or {})
        write_text(self.spark, f"{self.root}/{name}_report.json", json.dumps(out, indent=1, default=str))
        return out


def refresh(run: Run, products: dict[str, dict[str, str]], availability: str, since: int, edges: DataFrame | None = None) -> str:
    """Fetch the years of detections that the service has more of than the last refresh saw, and move the data end on. The new data end comes back.

    products: for each sensor the product's name in the availability table and
    the options of the paged reader (url and so on). A year counts as complete
    up to the data end on record; only years beyond that are fetched, whole, and
    replace what the archive holds of them. Detections are clipped to the
    polygons of `edges`. The data end is the last day that every product
    covers, and is written after the archive, so a run that breaks off fetches
    again. A product that the table doesn't list is an error.
    """
    spark, archive, end_file = run.spark, f"{run.root}/archive", f"{run.root}/data_end.json"
    latest = {r["product"]: r.last_day for r in read_availability(spark, availability).collect()}  # a row a product
    missing = sorted({p["product"] for p in products.values()} - set(latest))
    if missing:
        raise LookupError(f"not available: {', '.join(missing)}")
    seen = last_day(spark, end_file, "")
    for sensor, options in products.items():
        newest = latest[options["product"]]
        years = list(range(since, int(newest[:4]) + 1))
        on_record = {int(y) for y in folder_values(spark, f"{archive}/sensor={sensor}", "year")}
        known = {y: min(f"{y}-12-31", seen) for y in years if y in on_record}
        service = {k: v for k, v in options.items() if k != "product"}
        for year in stale_years(known, newest, years):
            raw = fetch_days(spark, f"{year}-01-01", min(f"{year}-12-31", newest), edges, **service)
            typed = raw.select(F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"), F.col("frp").try_cast("double").alias("frp"), "acq_date", "acq_time", "satellite", "confidence", "daynight")
            refresh_years(normalise(typed.withColumn("sensor", F.lit(sensor)).withColumn("type", F.lit(None).cast("int"))), archive)
    end = watermark({p["product"]: latest[p["product"]] for p in products.values()})
    write_text(spark, end_file, json.dumps({"data_end": end}))
    return end


def prepare(run: Run, detections: DataFrame, edges: DataFrame, keys: list[str], step: float = 0.1) -> DataFrame:
    """detections tagged with the polygon around them, by sensor and year."""
    tagged = spatial.tag_polygons(detections, edges, keys, step)
    return run.write("detections", lambda: detections.join(tagged, keys, "left"), ("sensor", "year"))


def slope_raster(run: Run, tiles: DataFrame, zoom: int, x0: int, y0: int, reads: tuple[str, ...] = ()) -> DataFrame:
    """The mosaic of elevation tiles (tx, ty, r, c, value) with slopes, written once: later runs read it. With reads, the files and folders of the tiles, they do so while these stay as they are."""
    pixel_m = spatial.pixel_metres(spatial.pixel_lat(F.col("row"), y0, zoom), zoom)
    make = lambda: spatial.slope(spatial.mosaic(tiles, x0, y0), pixel_m)
    return run.kept(f"slope_raster-{zoom}-{x0}-{y0}", make, reads) if reads else run.write("slope_raster", make)


def build_grid(run: Run, slopes: DataFrame, people: DataFrame, edges: DataFrame, names: DataFrame, zoom: int, x0: int, y0: int, keep: list[str]) -> DataFrame:
    """Cells of the districts to keep: terrain, middle, district and population.

    slopes: slope_raster(). people: pixels (lat, lon, value). edges and names
    (poly_id, name): the districts. A cell lies where its middle lies.
    """
    step = run.cfg.cell_step
    placed = slopes.withColumn("lat", spatial.pixel_lat(F.col("row"), y0, zoom)).withColumn("lon", spatial.pixel_lon(F.col("col"), x0, zoom))
    cells = spatial.zonal_stats(with_cells(placed, step), run.cfg.steep_degrees)
    cells = cells.withColumn("lat", centre("ci", step)).withColumn("lon", centre("cj", step))
    tags = spatial.tag_polygons(cells, edges, ["ci", "cj"]).join(names.select("poly_id", F.col("name").alias("district")), "poly_id").drop("poly_id")
    kept = cells.join(tags.filter(F.col("district").isin(*keep)), ["ci", "cj"])
    pixels = with_cells(people, step).select("ci", "cj", "value")
    return run.write("grid", lambda: spatial.cell_population(pixels, kept))


def harmonize(run: Run, detections: DataFrame, clean_years: list[int], outages: list[tuple[str, str]] = (), seed: int = 0, train_until: int | None = None) -> dict[str, DataFrame]:
    """calendar, calendar_annual, factors, drift, gap months and the harmonization report; outage days leave the calibration of both sensors.

    train_until: the last year of the chronological training set, by default the second last clean year.
    """
    cfg, spark = run.cfg, run.spark
    veg = counts.vegetation(detections)
    months = run.write("months", lambda: counts.monthly_counts(veg, cfg))
    valid = run.write("calibration_months", lambda: counts.monthly_counts(counts.without_outages(veg, list(outages)) if outages else veg, cfg))
    clean = valid.filter(F.col("year").isin(clean_years))
    factors = run.write("factors", lambda: calibration.ratio_by_group(clean))
    boot = run.write("bootstrap", lambda: uncertainty.bootstrap_factors(clean, uncertainty.random_draws(spark, clean_years, cfg.replicates, seed)))
    drift = run.write("drift", lambda: counts.overpass_drift(detections, (min(clean_years), max(clean_years))))
    gaps = run.write("gaps", lambda: counts.gap_months(detections, cfg.first_year))
    series = run.write("replicates", lambda: uncertainty.replicate_series(months, boot, cfg.overlap_from))

    def calendar() -> DataFrame:
        base = calibration.naive_stitch(calibration.harmonize(months, factors, cfg.overlap_from), cfg.overlap_from)
        base = base.join(uncertainty.band(series, ["year", "month", "region"]), ["year", "month", "region"], "left")
        drifted = drift.filter("drifted").select("year", F.lit(True).alias("drifted"))
        gapped = gaps.select("year", "month", F.lit(True).alias("gap"))
        return base.join(drifted, "year", "left").join(gapped, ["year", "month"], "left").fillna(False, ["drifted", "gap"])

    table = run.write("calendar", calendar)
    annual = run.write("calendar_annual", lambda: uncertainty.annual_rollup(table, series))
    scores = run.write("loyo_scores", lambda: calibration.score_overall(calibration.leave_one_year_out(clean)))

    cut = sorted(clean_years)[-2] if train_until is None and len(clean_years) > 1 else train_until or max(clean_years)
    early, late = F.col("year") <= cut, F.col("year") > cut
    held_out = lambda train, test: calibration.score_overall(calibration.predict(train, test))
    off = [r.year for r in drift.filter("drifted").select("year").collect()]  # a row a year
    full = [r.year for r in counts.complete_years(months).collect()]
    burning = lambda df: df.filter("region = 'hills' and season = 'burn'")
    yearly = lambda df, c, *keys: df.groupBy(*keys, "year").agg(F.sum(c).alias("v"))
    taus = stats.kendall_theilsen(yearly(burning(series), "value", "rep"), "year", "v", ("rep",), with_p=True)
    before, after = (cfg.first_year, cfg.overlap_from - 1), (cfg.overlap_from, max([y for y in full if y >= cfg.overlap_from], default=cfg.last_year))
    over = [y for y in full if y >= cfg.overlap_from]
    subsets = {"clean years": clean_years, f"up to {cut}": [y for y in clean_years if y <= cut], "all years": sorted({*over, cfg.last_year}), "drifted years": off}
    frames = {
        "data_end": detections.agg(F.max("date").cast("string").alias("last")),
        "factors": factors, "factor_interval": uncertainty.band(boot, ["region", "season"], "factor"),
        "jump": uncertainty.jump(table, before, after, ["naive", "harmonized", "count_a"]).crossJoin(uncertainty.jump_interval(series, before, after)),
        "trend": stats.kendall_theilsen(yearly(burning(table), "harmonized"), "year", "v", with_p=True).crossJoin(taus.agg(F.avg(((F.col("tau") < 0) & (F.col("p") < 0.05)).cast("double")).alias("share_falling"))),
        "trend_all": stats.kendall_theilsen(yearly(table.filter(F.col("year").isin(full)), "harmonized"), "year", "v", with_p=True),
        "drift": drift, "gap_months": gaps, "outages": spark.createDataFrame(list(outages), "start string, end string"),
        "leave_one_year_out": scores, "chronological_holdout": held_out(clean.filter(early), clean.filter(late)),
        "post_drift_divergence": held_out(clean, valid.filter(F.col("year").isin(off))),
        "calibration_sensitivity": calibration.sensitivity(valid, {k: v for k, v in subsets.items() if v}),
        "per_year_ratio": calibration.per_year_ratio(valid, cfg.overlap_from),
    }
    run.report("harmonization", frames, {"data_end": lambda rows: rows[0]["last"], "jump": lambda rows: rows[0], "trend": lambda rows: rows[0] if rows else None})
    return {"calendar": table, "calendar_annual": annual, "factors": factors, "loyo_scores": scores}


def build_history(run: Run, detections: DataFrame, grid: DataFrame, clean_years: list[int], train_until: int | None = None) -> dict[str, DataFrame]:
    """cell_history, cell_summary, the curve and the history report, which checks a curve of the earlier clean years on the later ones."""
    cfg = run.cfg
    season = counts.vegetation(detections).filter(F.col("month").isin(*cfg.burn_months) & (F.col("region") == "hills"))
    panel = run.write("season_table", lambda: history.season_table(season, grid, cfg))
    clean = panel.filter(F.col("year").isin(clean_years))
    curve = run.write("curve", lambda: history.curve_fit(clean, cfg.bins))
    factor = run.tables.table("factors").filter("region = 'hills' and season = 'burn'").select("factor")
    flags = run.write("cell_history", lambda: history.cell_flags(panel, curve, factor, cfg.overlap_from))
    cells = run.write("cell_summary", lambda: history.cell_summary(flags, cfg))
    cut = sorted(clean_years)[-2] if train_until is None and len(clean_years) > 1 else train_until or max(clean_years)
    test = history.curve_apply(clean.filter(F.col("year") > cut), history.curve_fit(clean.filter(F.col("year") <= cut), cfg.bins), cfg.bins)
    sums = history.per_cell_sums(test)
    frames = {
        "curve": curve, "patterns": cells.groupBy("pattern").agg(F.count("*").alias("cells")),
        "looks_worse": cells.agg(F.count_if("looks_worse_naive").alias("naive"), F.count_if("looks_worse_harmonized").alias("harmonized")),
        "holdout": history.brier_check(test).crossJoin(stats.spearman(sums, "y", "p")), "reliability": history.reliability(test), "share_by_year": history.share_by_year(flags),
    }
    run.report("history", frames, {"looks_worse": lambda rows: rows[0], "holdout": lambda rows: rows[0]})
    return {"cell_history": flags, "cell_summary": cells, "curve": curve}


METHODS = {"last_year": "score_last_year", "history": "score_history", "long_history": "score_long_history", "boosted": "score_boosted"}


def forecast(run: Run, detections: DataFrame, grid: DataFrame, clean_years: list[int], years: list[int], target: int, first_target: int | None = None, **boosting) -> dict[str, DataFrame]:
    """All four methods judged over past seasons, and the scores of every cell for the target season by the method chosen.

    For each season of `years` curve, factor, features and boosted trees are
    made from seasons before it alone. The simplest method within the tolerance
    of the best is chosen; the target season's scores use all seasons.
    """
    cfg, spark = run.cfg, run.spark
    season = counts.vegetation(detections).filter(F.col("month").isin(*cfg.burn_months) & (F.col("region") == "hills") & (F.col("sensor") == "B"))
    days = run.write("fire_days", lambda: features.fire_days(season, cfg.cell_step))
    panel, months = run.tables.table("season_table"), run.tables.table("calibration_months").filter(F.col("year").isin(clean_years))
    first = first_target or cfg.overlap_from + 1
    origins = [*years, target]
    known = run.write("known_then", lambda: history.history_as_of(panel, months, origins, cfg, clean_years))

    def rows_of(t: int) -> DataFrame:
        """Training seasons and the season t, all seen with the history known before t."""
        then = known.filter(F.col("origin") == t).drop("origin").crossJoin(spark.createDataFrame([(y,) for y in range(first, t + 1)], "origin int"))
        return features.rule_scores(features.dataset(grid, days, then, list(range(first, t + 1)), cfg)).withColumn("origin", F.lit(t))

    def dataset() -> DataFrame:
        out = None
        for t in origins:
            out = rows_of(t) if out is None else out.unionByName(rows_of(t))
        return out

    data = run.write("dataset", dataset, ("origin",))
    tested = run.write("tested", lambda: features.boosted_by_origin(data, years, **boosting))
    judged = run.write("rolling_origin", lambda: ranking.rolling_origin(tested, METHODS))
    means = judged.groupBy("method").agg(F.avg("p50").alias("p50"), F.avg("avg_precision").alias("ap"))
    chosen = ranking.choose_default(means, list(METHODS)).first().chosen
    now = data.filter(F.col("origin") == target)
    train, future = now.filter(F.col("year") < target), now.filter(F.col("year") == target)
    if tuple(train.agg(F.min("burned"), F.max("burned")).first()) == (0, 1):
        model = features.boosted(**boosting).fit(train)
        save_model(model, f"{run.root}/model")
        future = features.with_boosted(model, future)
    else:
        future = future.withColumn("score_boosted", F.lit(0.0))
    out = run.write("forecast", lambda: future.withColumn("forecast_score", F.col(METHODS[chosen])).withColumn("method", F.lit(chosen)).drop("burned", "origin"))
    measures = [c for c in judged.columns if c not in ("method", "year", "base_rate")]
    frames = {"summary": ranking.over_seasons(judged, measures), "per_year": judged, "base_rate": tested.groupBy("year").agg(F.avg("burned").alias("rate")).orderBy("year")}
    run.report("model", frames, {}, {"chosen": chosen, "target": target, "methods": list(METHODS)})
    return {"rolling_origin": judged, "forecast": out}


def fire_points(run: Run, detections: DataFrame, grid: DataFrame, slopes: DataFrame, people: DataFrame, zoom: int, x0: int, y0: int, people_at: tuple[float, float, float], footprint_m: float = 375.0) -> DataFrame:
    """Season detections of record B inside the grid with the slope and steep share around them, and people in boxes of 3 and 5 pixels.

    slopes: slope_raster(). people: raster (row, col, value) whose first pixel
    begins at people_at (north, west, step). footprint_m: width of a
    detection's footprint in metres.
    """
    cfg = run.cfg
    season = counts.vegetation(detections).filter(F.col("month").isin(*cfg.burn_months) & (F.col("region") == "hills") & (F.col("sensor") == "B"))
    pts = members(with_cells(season.drop("slope", "steep", "people_r1", "people_r2"), cfg.cell_step), grid, ("ci", "cj"))
    spots = run.write("fire_spots", lambda: pts.select("lat", "lon").distinct())
    footprint = spatial.footprint_radius(pts, zoom, footprint_m)
    keys = ["lat", "lon"]
    ground = spatial.footprint_slope(spatial.tile_pixel(spots, zoom, x0, y0), slopes, keys, footprint, cfg.steep_degrees).withColumnsRenamed({"mean_slope": "slope", "steep_share": "steep"})
    at = raster_position(spots, *people_at)
    for radius in (1, 2):
        ground = ground.join(spatial.box_population(at, people, keys, radius).withColumnRenamed("people", f"people_r{radius}"), keys)
    return run.write("fire_points", lambda: pts.join(ground, keys, "left"))


def watchlist(run: Run, points: DataFrame, grid: DataFrame, places: DataFrame, season: int, origins: list[int] = ()) -> DataFrame:
    """Observed and forecast lists in one table, and the watchlist report. points: fire_points(), or detections of the season's months with slope, steep, people_r1 and people_r2."""
    cfg = run.cfg
    pts = with_cells(points.filter("sensor = 'B'"), cfg.cell_step)
    scores = run.tables.table("forecast").select("ci", "cj", "forecast_score", "score_boosted")
    around = neighbour_mean(grid.select("ci", "cj", "population"), "population", "_around")
    base = grid.join(around.select("ci", "cj", F.round(F.col("population") + 8 * F.col("_around")).alias("people_3x3")), ["ci", "cj"]).join(scores, ["ci", "cj"], "left")
    now = ranking.per_cell(pts.filter(F.col("year") == season))
    observed = run.write("observed_cells", lambda: base.join(now, ["ci", "cj"], "left").fillna(0, ["fire_points", "fire_days"]))
    usual = ranking.per_cell(pts.filter(F.col("year") <= season)).drop("fire_points", "fire_days")
    ahead = run.write("forecast_cells", lambda: base.join(usual, ["ci", "cj"], "left").join(observed.select("ci", "cj", "fire_points", "fire_days"), ["ci", "cj"]))
    lists = None
    for kind, cells, year in (("observed", observed, season), ("forecast", ahead, season + 1)):
        part = ranking.prioritise(cells, kind, cfg.top).withColumn("kind", F.lit(kind)).withColumn("season", F.lit(year))
        lists = part if lists is None else lists.unionByName(part)
    near = spatial.nearest_place(grid.select("ci", "cj", "lat", "lon"), places, ["ci", "cj"])
    told = run.tables.table("cell_summary").select("ci", "cj", "active_seasons", "active_seasons_naive", "share_active", "pattern", "streak", "first_likely")
    table = run.write("watchlist", lambda: lists.join(told, ["ci", "cj"], "left").join(near, ["ci", "cj"], "left"))
    first = table.filter("priority = 'inspect first'")
    frames = {
        "counts": table.groupBy("kind", "season", "priority").agg(F.count("*").alias("cells")), "districts": first.groupBy("kind", "district").agg(F.count("*").alias("cells")),
        "people": first.groupBy("kind").agg(F.sum("population").alias("people")), "patterns": first.groupBy("kind", "pattern").agg(F.count("*").alias("cells")),
        "top": table.filter("rank <= 5").select("kind", "rank", "priority", "district", "place", "lat", "lon", "score", "robustness", "pattern", "active_seasons").orderBy("kind", "rank"),
        "robustness": ranking.robustness_summary(observed, "observed", cfg.top).withColumn("kind", F.lit("observed")).unionByName(ranking.robustness_summary(ahead, "forecast", cfg.top).withColumn("kind", F.lit("forecast"))),
    }
    if "people_cell" in grid.columns and "slope_mean" in grid.columns:
        frames["coincidence"] = ranking.coincidence(observed)
    if origins:
        days = run.tables.table("fire_days")
        frames["backtest"] = ranking.backtest(pts, grid, days, list(origins), cfg.overlap_from, cfg.top)
        frames["chance"] = ranking.chance(pts, grid, list(origins), cfg.top)
    run.report("watchlist", frames)
    return table


#: Fires of a week that the live document holds itself; more are in the table live_fires alone.
INLINE_FIRES = 50_000


def live(run: Run, detections: DataFrame, grid: DataFrame, places: DataFrame, past: DataFrame, years: list[int], source: str, last: str | None, days: int = 7) -> dict:
    """The live document from the latest detections, written as one compact file: counts, fires as rows of values, alerts.

    last: the newest day that came, of all regions. The fires are a table of
    their own as well; a week of more than INLINE_FIRES is only there.
    """
    static = run.write("static_cells", lambda: watch.static_cells(past))
    made = watch.build(detections, static, grid, watch.listed_seasons(run.tables.table("watchlist")), places, past, years, last, days)
    return _document(run, made, source)


def _document(run: Run, made: dict[str, DataFrame], source: str) -> dict:
    fires = run.write("live_fires", lambda: as_arrays(made["fires"]))
    [counts_] = [r.json for r in as_json(made["counts"]).collect()]
    alerts = [r.json for r in as_json(made["alerts"]).collect()]  # one for each cell of the grid at most
    shown = [r.json for r in fires.limit(INLINE_FIRES + 1).collect()]
    where = f'"fires":[{",".join(shown)}]' if len(shown) <= INLINE_FIRES else '"fires_table":"live_fires"'
    text = f'{{"source":{json.dumps(source)},"counts":{counts_},{where},"alerts":[{",".join(alerts)}]}}'
    write_text(run.spark, f"{run.root}/live.json", text)
    return json.loads(text)


def live_file(run: Run, path: str, box: tuple[float, float, float, float], edges: DataFrame, grid: DataFrame, places: DataFrame, past: DataFrame, years: list[int], source: str = "a saved file", days: int = 7) -> dict:
    """live() from a saved file: those of its detections that lie in the polygons of `edges`, over the days up to the newest of the whole file.

    box: west, south, east, north; detections outside are not looked at. A file of other text than detections is an error.
    """
    raw, last = read_live(run.spark, path, box)
    found = normalise(raw.withColumn("sensor", F.lit("B")).withColumn("type", F.lit(None).cast("int"))).withColumn("hhmm", F.lpad(F.col("hhmm").cast("string"), 4, "0"))
    found = found.withColumn("id", F.xxhash64("lat", "lon", "date", "hhmm", "satellite"))
    spots = tag_polygons(found.select("lat", "lon").distinct(), edges, ["lat", "lon"]).filter("poly_id is not null").select("lat", "lon")
    return live(run, found.join(spots, ["lat", "lon"], "left_semi"), grid, places, past, years, source, last, days)


def live_stream(run: Run, arrivals: DataFrame, grid: DataFrame, places: DataFrame, past: DataFrame, years: list[int], source: str, days: int = 7) -> list[dict]:
    """live() over a folder that detections arrive in: a batch reads the files that have come since the last one, and the week's cells.

    arrivals: a stream (streaming.watch.arrivals) of id, ts, date, hhmm, lat,
    lon, frp and inside, whether the region holds it. After each batch the
    document is what live() makes of all that ever came. A batch that is worked
    off again after a failure replaces what it wrote. Spark's progress of each
    batch comes back.
    """
    spark = run.spark
    static = run.write("static_cells", lambda: watch.static_cells(past))
    listed = watch.listed_seasons(run.tables.table("watchlist"))
    changes = cell_days(arrivals, static, grid, listed, days)
    key = ["day", "scope", "ci", "cj"]

    def work(batch: DataFrame, number: int) -> None:
        at = f"{run.root}/live_week"
        write_table(batch.withColumn("part", F.when(F.col("kind") == "cell", "cells").otherwise(F.col("day").cast("string"))), f"{at}/changes/batch={number}", ("part",))
        came = spark.read.schema(f"{DAY_OUT}, part string").parquet(f"{at}/changes/batch={number}").filter("part = 'cells'").drop("part")
        before = [n for n in numbered_folders(spark, f"{at}/cells", "version") if n < number]
        week = came
        if before:
            week = spark.read.schema(DAY_OUT).parquet(f"{at}/cells/version={before[-1]}").join(came.select(*key), key, "left_anti").unionByName(came)
        last = week.agg(F.max("day")).first()[0]
        write_table(week.filter(F.col("day") > F.date_sub(F.lit(last), days)), f"{at}/cells/version={number}")
        drop_folders(spark, [f"{at}/cells/version={n}" for n in before[:-1]])
        week = spark.read.schema(DAY_OUT).parquet(f"{at}/cells/version={number}")
        if last is None:
            return
        first_day = str(last - timedelta(days=days - 1))
        old = [n for n in numbered_folders(spark, f"{at}/changes", "batch") if n < number and not any(p >= first_day for p in folder_values(spark, f"{at}/changes/batch={n}", "part") if p != "cells")]
        drop_folders(spark, [f"{at}/changes/batch={n}" for n in old])
        # Folders named by day: days before the window are not read.
        fires = spark.read.schema(f"{DAY_OUT}, batch int, part string").parquet(f"{at}/changes").filter((F.col("part") >= first_day) & (F.col("part") != "cells") & (F.col("batch") <= number))
        made = {
            "counts": watch.with_normal(watch.counts_of_days(week), grid, static, past, years, str(last), days),
            "fires": watch.compact(fires.withColumn("date", F.col("day"))),
            "alerts": watch.placed_alerts(watch.alerts_of_days(week, grid, listed), grid, places),
        }
        _document(run, made, source)

    return run_available(changes, work, f"{run.root}/live_state", "update")


def check_imagery(run: Run, pixels: DataFrame | None, n: int, seed: int, pixels_per_cell: int, valid: list[int], recent_since: int) -> dict:
    """Sample cells, judge their before and after images, hand out a blind kit, and report; without pixels, score what was judged before again.

    pixels: cell (as "ci_cj"), window, scene, place, row, col, nir, swir, scl.
    The report says whether the cells judged are still those the list would give.
    """
    lists = run.tables.table("watchlist").filter("kind = 'observed'")
    recent = run.tables.table("fire_days").filter(F.col("year") >= recent_since)
    sample = imagery.sample_cells(lists, recent, n, seed, run.cfg.steep_degrees)
    if pixels is not None:
        chosen = run.write("image_sample", lambda: sample)
        wanted = chosen.withColumn("cell", F.concat_ws("_", "ci", "cj"))
        verdicts = imagery.dnbr_cell(imagery.nbr_composite(pixels.join(wanted.select("cell"), "cell", "left_semi"), valid), pixels_per_cell)
        result = run.write("image_check", lambda: wanted.join(verdicts, "cell", "left").fillna({"verdict": "no clear imagery"}))
        sheet, key = imagery.blind_kit(result, seed + 1)
        write_csv(sheet, f"{run.root}/blind_sheet")
        write_csv(key, f"{run.root}/blind_key")
    else:
        result = run.tables.table("image_check")
    clear = result.filter("verdict != 'no clear imagery'")
    pairs = [("priority", "control"), ("fire", "control"), ("priority", "fire")]
    tests = None
    for a, b in pairs:
        one = stats.mann_whitney_test(clear, "group", "scar_share", a, b).withColumn("first", F.lit(a)).withColumn("second", F.lit(b))
        tests = one if tests is None else tests.unionByName(one)
    frames = {"groups": imagery.group_summary(result), "thresholds": imagery.threshold_matrix(result), "tests": tests, "current": imagery.still_current(result, sample)}
    return run.report("imagery", frames, {"current": lambda rows: rows[0]["sample_matches_list"]})
