"""The data behind the reports and maps, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.config import CONFIG
from quillspan.sources.writers import read_report

SENSORS, PRIORITIES, KINDS, REGIONS = ("A", "B", "all"), ("inspect first", "inspect", "monitor", "none"), ("observed", "forecast"), ("all", "hills", "plains")


class NotBuilt(LookupError):
    """A table or report that no run has written yet."""


class OutsideGrid(LookupError):
    """A point in no cell of the grid."""


def _within(name: str, value, lo: int, hi: int) -> None:
    if value is not None and not lo <= value <= hi:
        raise ValueError(f"{name} must be from {lo} to {hi}")


def _one_of(name: str, value, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


class Tables:
    """Written tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        if not self._exists(name):
            raise NotBuilt(name)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def optional(self, name: str) -> DataFrame | None:
        return self.table(name) if self._exists(name) else None

    def report(self, name: str) -> dict:
        if not self._exists(f"{name}_report.json"):
            raise NotBuilt(f"{name} report")
        return read_report(self.spark, f"{self.root}/{name}_report.json")

    def optional_report(self, name: str) -> dict | None:
        return self.report(name) if self._exists(f"{name}_report.json") else None

    def health(self) -> list[str]:
        """Names of what has been built."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def fires(detections: DataFrame, year: int, month: int | None = None, sensor: str = "all", hills_only: bool = False, limit: int = 20_000, years: tuple[int, int] = (CONFIG.first_year, 2030)) -> DataFrame:
    """Detections of kind 0 for a map, in order of date and id; year must be within years."""
    _within("year", year, *years)
    _within("month", month, 1, 12)
    _within("limit", limit, 1, 100_000)
    _one_of("sensor", sensor, SENSORS)
    out = detections.filter((F.col("year") == year) & (F.col("kind") == 0))
    for wanted, test in ((month, F.col("month") == month), (sensor != "all", F.col("sensor") == sensor), (hills_only, F.col("region") == "hills")):
        out = out.filter(test) if wanted else out
    return out.orderBy("date", "id").limit(limit)


def calendar(months: DataFrame, region: str = "all") -> DataFrame:
    """Monthly sums; sums of nulls alone stay null."""
    _one_of("region", region, REGIONS)
    kept = months if region == "all" else months.filter(F.col("region") == region)
    values = [c for c in ("count_a", "raw_b", "celldays_b", "naive", "harmonized", "lo", "hi") if c in months.columns]
    flags = [c for c in ("drifted", "gap") if c in months.columns]
    return kept.groupBy("year", "month").agg(*(F.sum(c).alias(c) for c in values), *(F.bool_or(c).alias(c) for c in flags))


def calendar_annual(annual: DataFrame, region: str = "all") -> DataFrame:
    _one_of("region", region, REGIONS)
    return annual.filter(F.col("region") == region).drop("region")


def watchlist(table: DataFrame, kind: str = "observed", priority: str | None = None, district: str | None = None, limit: int = 50, imagery: DataFrame | None = None) -> DataFrame:
    """The first rows of a list; imagery columns join what is left after the limit, to observed rows alone."""
    _one_of("kind", kind, KINDS)
    _within("limit", limit, 1, 5000)
    out = table.filter(F.col("kind") == kind)
    if priority is not None:
        _one_of("priority", priority, PRIORITIES)
        out = out.filter(F.col("priority") == priority)
    if district is not None:
        out = out.filter(F.lower("district") == district.lower())
    out = out.orderBy("rank").limit(limit)
    if imagery is not None:
        extra = imagery.select("ci", "cj", F.lit("observed").alias("kind"), *(F.col(c).alias(f"image_{c}") for c in imagery.columns if c not in ("ci", "cj")))
        out = out.join(extra, ["ci", "cj", "kind"], "left")
    return out


def map_rows(table: DataFrame, kind: str = "observed") -> DataFrame:
    """Cells with any activity; the least urgent first, so that others are drawn over them."""
    _one_of("kind", kind, KINDS)
    return table.filter((F.col("kind") == kind) & (F.col("priority") != "none")).orderBy(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")).desc(), "rank")


def district_rollup(table: DataFrame) -> DataFrame:
    of = lambda p: F.count_if(F.col("priority") == p)
    return table.groupBy("district").agg(F.count("*").alias("cells"), of("inspect first").alias("inspect_first"), of("inspect").alias("inspect"), of("monitor").alias("monitor"), F.max("score").alias("max_score")).orderBy(F.desc("inspect_first"), F.desc("inspect"), "district")


def cell_of(lat: float, lon: float, step: float = CONFIG.cell_step) -> tuple[int, int]:
    from math import floor

    return floor(lat / step), floor(lon / step)


def cell_history(table: DataFrame, lat: float, lon: float, grid: DataFrame | None = None) -> DataFrame:
    """Rows of the cell around a point; with a grid, a point outside it is an error."""
    ci, cj = cell_of(lat, lon)
    here = (F.col("ci") == ci) & (F.col("cj") == cj)
    if grid is not None and grid.filter(here).isEmpty():
        raise OutsideGrid(f"({lat}, {lon})")
    return table.filter(here)


def cell_page(tables: "Tables", lat: float, lon: float, imagery: DataFrame | None = None) -> dict[str, DataFrame]:
    """All about the cell around a point, from five tables: cell, history by year, history_summary, watchlist (both lists) and forecast_scores.

    Filters on the cell reach the scans. A point outside the grid is an error.
    """
    ci, cj = cell_of(lat, lon)
    here = (F.col("ci") == ci) & (F.col("cj") == cj)
    cell = tables.table("grid").filter(here)
    if cell.isEmpty():
        raise OutsideGrid(f"({lat}, {lon})")
    lists = tables.table("watchlist").filter(here)
    if imagery is not None:
        extra = imagery.filter(here).select("ci", "cj", F.lit("observed").alias("kind"), *(F.col(c).alias(f"image_{c}") for c in imagery.columns if c not in ("ci", "cj")))
        lists = lists.join(extra, ["ci", "cj", "kind"], "left")
    scores = tables.table("forecast").filter(here)
    scores = scores.select(*(F.bround(c, 4).alias(c) for c in scores.columns if c.startswith("score_")))
    history = tables.table("cell_history").filter(here).join(tables.table("season_table").filter(here), ["ci", "cj", "year"], "left").orderBy("year")
    return {
        "cell": grid_rows(cell), "history": history.drop("ci", "cj"), "history_summary": tables.table("cell_summary").filter(here).drop("ci", "cj"),
        "watchlist": lists.drop("ci", "cj"), "forecast_scores": scores,
    }


REPORTS = ("harmonization", "history", "model", "watchlist", "imagery")


def validation(tables: "Tables") -> dict[str, dict | None]:
    """Every report that runs have written, null for those not yet there."""
    return {name: tables.optional_report(name) for name in REPORTS}


def summary(tables: "Tables") -> dict:
    """The figures that matter of each report; imagery may be missing, the others may not."""
    h, p, m, w = (tables.report(name) for name in ("harmonization", "history", "model", "watchlist"))
    pick = lambda rows, method: next((r for r in rows if r["method"] == method), None)
    errors = lambda name: {k: (pick(h["chronological_holdout"], k) or {}).get(name) for k in ("climatology", "global_raw", "global_celldays", "region")}
    rates = [r["rate"] for r in m["base_rate"]]
    return {
        "data_end": h["data_end"], "jump": h["jump"], "trend": h["trend"], "factors": h["factors"], "factor_interval": h["factor_interval"],
        "chronological_holdout": {"ours": pick(h["chronological_holdout"], "region_season"), "naive": pick(h["chronological_holdout"], "naive")},
        "drift": h["drift"], "outages": h["outages"], "gap_months": h["gap_months"],
        "baselines": errors("regional_err_pct"), "baselines_national": errors("national_err_pct"),
        "looks_worse": p["looks_worse"], "holdout": p["holdout"],
        "forecast": {"chosen": m["chosen"], "comparison": m["summary"], "base_rate": round(sum(rates) / len(rates), 3) if rates else None},
        "watchlist": w, "imagery": tables.optional_report("imagery"),
    }


def history_share(flags: DataFrame) -> DataFrame:
    """Share of active cells by year, calibrated and naive, at three places."""
    from quillspan.operators.history import share_by_year

    return share_by_year(flags).select("year", *(F.bround(F.round(c, 9), 3).alias(c) for c in ("harmonized", "naive"))).orderBy("year")


def grid_rows(grid: DataFrame) -> DataFrame:
    return grid.select(*(F.bround(c, 3).alias(c) if t == "double" else F.col(c) for c, t in grid.dtypes if c not in ("ci", "cj")))
