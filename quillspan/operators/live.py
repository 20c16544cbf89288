"""Recent-window watch: suppress static sources, find what needs a look, compare with normal weeks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.grid import dilate, members, with_cells
from quillspan.operators.spatial import flat_km, nearest_place

FINE, CELL = ["fi", "fj"], ["ci", "cj"]


def decode_confidence(raw: Column) -> Column:
    """Letters l, n, h as 20, 60, 90, numbers as they are, anything else null."""
    return F.when(raw == "l", 20.0).when(raw == "n", 60.0).when(raw == "h", 90.0).otherwise(raw.try_cast("double"))


def same_day(end: Column, year: Column) -> Column:
    """The day in another year; 29 February becomes the 28th."""
    return F.add_months(end, 12 * (year - F.year(end)))


def static_cells(df: DataFrame, step: float = 0.01) -> DataFrame:
    """Fine cells around detections of a kind other than 0."""
    return dilate(with_cells(df.filter("kind != 0"), step, ("fi", "fj")))


def window(df: DataFrame, last: str, days: int = 7) -> DataFrame:
    """Detections of the days up to `last`, both ends included. last is the newest day of the file as it came: the newest day of a clipped table would slide the window back wherever the region saw no fire on that day."""
    end = F.to_date(F.lit(last))
    return df.filter((F.col("date") > F.date_sub(end, days)) & (F.col("date") <= end))


def enrich(df: DataFrame, static: DataFrame, grid: DataFrame, listed: DataFrame, step: float = 0.02, min_slope: float = 15.0, min_people: float = 200.0) -> DataFrame:
    """Detections off static sources with their cell's columns, hills, check and level (2 check, 1 hills, 0 other)."""
    placed = members(with_cells(df, 0.01, ("fi", "fj")), static, ("fi", "fj"), inside=False).drop("fi", "fj")
    return with_checks(placed, grid, listed, step, min_slope, min_people)


def with_checks(df: DataFrame, grid: DataFrame, listed: DataFrame, step: float = 0.02, min_slope: float = 15.0, min_people: float = 200.0) -> DataFrame:
    """Detections (a stream too) with their cell's columns, hills, check and level."""
    out = with_cells(df, step).join(grid, CELL, "left").join(listed, CELL, "left")
    hills = F.col("slope_mean").isNotNull()
    steep = F.coalesce((F.col("slope_mean") >= min_slope) & (F.col("population") >= min_people), F.lit(False))
    check = hills & (steep | F.col("seasons").isNotNull())
    return out.withColumn("hills", hills).withColumn("check", check).withColumn("level", F.when(check, 2).when(hills, 1).otherwise(0))


def counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count("*").alias("fires"), F.count_if("hills").alias("hills"), F.count_if("check").alias("check"))


def static_count(df: DataFrame, static: DataFrame) -> DataFrame:
    """One row: how many detections lie on static sources."""
    return members(with_cells(df, 0.01, ("fi", "fj")), static, ("fi", "fj")).agg(F.count("*").alias("static"))


def normal_hills_week(df: DataFrame, grid: DataFrame, static: DataFrame, end: str, years: list[int], days: int = 7) -> DataFrame:
    """normal_week() of detections in the grid's cells and off static sources."""
    inside = members(with_cells(df, 0.02), grid, ("ci", "cj"))
    return normal_week(members(with_cells(inside, 0.01, ("fi", "fj")), static, ("fi", "fj"), inside=False), end, years, days)


def build(df: DataFrame, static: DataFrame, grid: DataFrame, listed: DataFrame, places: DataFrame, past: DataFrame, years: list[int], last: str | None, days: int = 7) -> dict[str, DataFrame]:
    """The whole watch over the `days` days up to `last`: counts (one row, with from, to, static and normal), fires and alerts.

    last: the newest day of all detections as they came, those of other
    regions included (read_live() returns it); None, where none came at all,
    is today. df: detections of the region with conf, kind and so on. grid: ci, cj, lat,
    lon, slope_mean, population and what else a cell should show. places: as
    nearest_place() takes them, by their flat distance, named ones alone. past:
    detections that normal weeks of `years` are counted from.
    """
    last = last or str(date.today())
    recent = window(df, last, days)
    terrain = [c for c in grid.columns if c not in ("lat", "lon")]
    enriched = enrich(recent, static, grid.select(*terrain), listed)
    one = counts(enriched).crossJoin(static_count(recent, static))
    return {"counts": with_normal(one, grid, static, past, years, last, days), "fires": compact(enriched), "alerts": placed_alerts(alerts(enriched), grid, places)}


def with_normal(one: DataFrame, grid: DataFrame, static: DataFrame, past: DataFrame, years: list[int], last: str, days: int = 7) -> DataFrame:
    """The row of counts with normal, from and to."""
    one = one.crossJoin(normal_hills_week(past, grid, static, last, years, days)).withColumn("to", F.to_date(F.lit(last)))
    return one.withColumn("from", F.date_sub("to", days - 1))


def placed_alerts(found: DataFrame, grid: DataFrame, places: DataFrame) -> DataFrame:
    """Alerts in order, with the middle of their cell and the nearest named place."""
    at = grid.select(*CELL, F.bround("lat", 3).alias("lat"), F.bround("lon", 3).alias("lon"))
    near = nearest_place(grid.select(*CELL, "lat", "lon").join(found.select(*CELL), CELL, "left_semi"), places, CELL, flat_km, named_only=True)
    rows = found.join(at, CELL, "left").join(near.withColumn("km", F.bround("km", 1)), CELL, "left")
    return rows.orderBy(F.col("seasons").isNull(), ~F.col("check"), F.col("slope_mean").desc(), *CELL)


def alerts(enriched: DataFrame) -> DataFrame:
    """Per hill cell: fires, first and last time, and the cell's columns; listed cells first, then those to check, then the steepest."""
    when = F.struct("date", "hhmm", "id")
    out = enriched.filter("hills").groupBy(*CELL).agg(
        F.count("*").alias("fires"), F.min_by(F.struct("date", "hhmm"), when).alias("first"), F.max_by(F.struct("date", "hhmm"), when).alias("last"),
        F.max("slope_mean").alias("slope_mean"), F.max("population").alias("population"), F.max("seasons").alias("seasons"), F.bool_or("check").alias("check"))
    return out.orderBy(F.col("seasons").isNull(), ~F.col("check"), F.col("slope_mean").desc(), *CELL)


def alerts_of_days(cell_days: DataFrame, grid: DataFrame, listed: DataFrame) -> DataFrame:
    """What alerts() gives, from the days of cells that a stream keeps (streaming.watch.cell_days)."""
    out = cell_days.filter("scope = 'fire' and hills").groupBy(*CELL).agg(
        F.sum("fires").alias("fires"), F.min(F.struct("day", "first", "first_id")).alias("a"), F.max(F.struct("day", "last", "last_id")).alias("b"), F.bool_or("check").alias("check"))
    when = lambda s, c: F.struct(F.col(f"{s}.day").alias("date"), F.col(f"{s}.{c}").alias("hhmm"))
    shown = out.select(*CELL, "fires", when("a", "first").alias("first"), when("b", "last").alias("last"), "check")
    return shown.join(grid.select(*CELL, "slope_mean", "population"), CELL, "left").join(listed, CELL, "left").select(*CELL, "fires", "first", "last", "slope_mean", "population", "seasons", "check")


def counts_of_days(cell_days: DataFrame) -> DataFrame:
    """What counts() and static_count() give, from the days of cells."""
    fires = lambda c: F.coalesce(F.sum(F.when(c, F.col("fires"))), F.lit(0))
    free = F.col("scope") == "fire"
    return cell_days.agg(fires(free).alias("fires"), fires(free & F.col("hills")).alias("hills"), fires(free & F.col("check")).alias("check"), fires(F.col("scope") == "static").alias("static"))


def normal_week(df: DataFrame, end: str, years: list[int], days: int = 7) -> DataFrame:
    """One row: the mean number of rows in the week that ends on the same day of each year; years without any count 0."""
    table = df.sparkSession.createDataFrame([(y,) for y in years], "wy int").withColumn("last", same_day(F.to_date(F.lit(end)), F.col("wy")))
    daily = df.groupBy("date").agg(F.count("*").alias("n"))
    hit = F.broadcast(table).join(daily, (F.col("date") <= F.col("last")) & (F.col("date") > F.date_sub("last", days)), "inner").groupBy("wy").agg(F.sum("n").alias("n"))
    return table.join(hit, "wy", "left").agg(F.avg(F.coalesce("n", F.lit(0))).alias("normal"))


def listed_seasons(watchlist: DataFrame) -> DataFrame:
    """Seasons whose list holds the cell as 'inspect first', in order."""
    return watchlist.filter("priority = 'inspect first'").groupBy(*CELL).agg(F.sort_array(F.collect_set(F.col("season").cast("string"))).alias("seasons"))


def compact(enriched: DataFrame) -> DataFrame:
    """Rows for a map: rounded position, day, time, power, level."""
    return enriched.select(F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"), "date", "hhmm", F.bround("frp", 1).alias("frp"), "level")
