"""Comparable counts: filters, cell-days, dense monthly series, outages and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.config import CONFIG, Config
from quillspan.operators.grid import cell


def region_of(district: Column, hills: tuple[str, ...]) -> Column:
    return F.when(F.coalesce(district.isin(*hills), F.lit(False)), "hills").otherwise("plains")


def season_of(month: Column, burn: tuple[int, ...] = CONFIG.burn_months) -> Column:
    return F.when(month.isin(*burn), "burn").otherwise("off")


def vegetation(df: DataFrame, all_satellites: bool = False) -> DataFrame:
    """Detections of kind 0 inside a region; of record A one satellite only, unless all are asked for."""
    own = F.lit(True) if all_satellites else (F.col("sensor") == "B") | (F.col("satellite") == "Aqua")
    return df.filter((F.col("kind") == 0) & F.col("region").isNotNull() & own)


def outage_days(spark: SparkSession, spans: list[tuple[str, str]]) -> DataFrame:
    """The days of closed intervals, once each."""
    frame = spark.createDataFrame(spans, "a string, b string")
    return frame.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("date")).distinct()


def without_outages(df: DataFrame, spans: list[tuple[str, str]]) -> DataFrame:
    """Rows on other days; an interval list is configuration, so its days are few enough to broadcast."""
    return df.join(F.broadcast(outage_days(df.sparkSession, spans)), "date", "left_anti")


def cell_days(df: DataFrame, step: float = CONFIG.fine_step, order: str = "id") -> DataFrame:
    """One row per day and cell, with the other columns of the row that comes first by `order`."""
    rest = [c for c in df.columns if c not in ("date", "fi", "fj")]
    keyed = df.withColumn("fi", cell("lat", step)).withColumn("fj", cell("lon", step))
    one = keyed.groupBy("date", "fi", "fj").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_one"))
    return one.select("date", "fi", "fj", "_one.*")


def gap_months(df: DataFrame, first_year: int = CONFIG.first_year, min_days: int = CONFIG.gap_days, share: float = CONFIG.gap_share) -> DataFrame:
    """Months in which Aqua has under `share` of Terra's fire days, where Terra has at least min_days."""
    days = df.filter((F.col("sensor") == "A") & (F.col("kind") == 0) & (F.col("year") >= first_year)).groupBy("year", "month")
    of = lambda s: F.count_distinct(F.when(F.col("satellite") == s, F.col("date")))
    return days.agg(of("Terra").alias("terra_days"), of("Aqua").alias("aqua_days")).filter((F.col("terra_days") >= min_days) & (F.col("aqua_days") < share * F.col("terra_days")))


def month_spine(spark: SparkSession, cfg: Config = CONFIG, regions: tuple[str, ...] = ("hills", "plains")) -> DataFrame:
    """Every month from the first year to the last month with data, in every region."""
    months = spark.range(cfg.first_year * 12, cfg.last_year * 12 + cfg.last_month).select(F.floor(F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    return months.withColumn("region", F.explode(F.array(*map(F.lit, regions))))


def monthly_counts(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Dense monthly series per region: count_a, raw_b and celldays_b (both null before the overlap) and season."""
    keys = ["year", "month", "region"]
    raw = df.groupBy(*keys).agg(F.count_if(F.col("sensor") == "A").alias("count_a"), F.count_if(F.col("sensor") == "B").alias("raw_b"))
    days = cell_days(df.filter("sensor = 'B'")).groupBy(*keys).agg(F.count("*").alias("celldays_b"))
    out = month_spine(df.sparkSession, cfg).join(raw, keys, "left").join(days, keys, "left")
    late = F.col("year") >= cfg.overlap_from
    out = out.withColumn("count_a", F.coalesce("count_a", F.lit(0)))
    for c in ("raw_b", "celldays_b"):
        out = out.withColumn(c, F.when(late, F.coalesce(c, F.lit(0))))
    return out.withColumn("season", season_of(F.col("month"), cfg.burn_months))


def complete_years(df: DataFrame) -> DataFrame:
    """Years with all twelve months."""
    return df.groupBy("year").agg(F.count_distinct("month").alias("months")).filter("months = 12").select("year")


def local_hour(hhmm: Column, shift: int = 6) -> Column:
    return F.floor(hhmm / 100) + F.pmod(hhmm, F.lit(100)) / 60 + shift


def overpass_drift(df: DataFrame, base_years: tuple[int, int], satellite: str = "Aqua", tolerance: float = CONFIG.drift_hours) -> DataFrame:
    """Median local hour by year of one satellite by day, the baseline over base_years, and whether a year drifted."""
    hours = df.filter((F.col("satellite") == satellite) & (F.col("daynight") == "D")).groupBy("year").agg(F.median(local_hour(F.col("hhmm"))).alias("hour"))
    base = hours.filter(F.col("year").between(*base_years)).agg(F.median("hour").alias("baseline"))
    # The baseline is one row.
    return hours.crossJoin(F.broadcast(base)).withColumn("drifted", F.coalesce(F.abs(F.col("hour") - F.col("baseline")) > tolerance, F.lit(False)))


def heat_class(value: Column, limits: tuple[int, ...] = (1, 10, 50, 200)) -> Column:
    """How many of the limits a count reaches; null reaches none."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in limits), F.lit(0))
