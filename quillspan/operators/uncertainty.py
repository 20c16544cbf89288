"""Bootstrap over years, interval bands, yearly rollups and jumps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.config import CONFIG


def random_draws(spark: SparkSession, years: list[int], n: int = CONFIG.replicates, seed: int = 0) -> DataFrame:
    """Years drawn with replacement: rep, year and how often. A table of its own, so that runs agree."""
    picks = np.random.default_rng(seed).choice(years, size=(n, len(years)))
    rows = [(rep, int(y), int(k)) for rep in range(n) for y, k in zip(*np.unique(picks[rep], return_counts=True), strict=True)]
    return spark.createDataFrame(rows, "rep int, year int, times int")


def hashed_draws(spark: SparkSession, years: list[int], n: int = CONFIG.replicates, seed: str = "boot-1") -> DataFrame:
    """Years drawn with replacement by a hash, which SQL can repeat: slot s of replicate r takes year md5('seed|r|s') mod (number of years), by the first 13 hex digits."""
    k = len(years)
    base = spark.range(n).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("slot").cast("string"))), 1, 13), 16, 10).cast("long")
    pick = F.element_at(F.array(*map(F.lit, years)), (number % k + 1).cast("int"))
    return base.select("rep", pick.alias("year")).groupBy("rep", "year").agg(F.count("*").cast("int").alias("times"))


def bootstrap_factors(months: DataFrame, draws: DataFrame) -> DataFrame:
    """Factors of every replicate from yearly sums, which are all a ratio needs; months are never resampled themselves."""
    yearly = months.groupBy("year", "region", "season").agg(F.sum("count_a").alias("a"), F.sum("celldays_b").alias("b"))
    drawn = draws.join(yearly, "year")
    return drawn.groupBy("rep", "region", "season").agg((F.sum(F.col("times") * F.col("a")) / F.greatest(F.sum(F.col("times") * F.col("b")), F.lit(1))).alias("factor"))


def replicate_series(months: DataFrame, factors: DataFrame, overlap_from: int = CONFIG.overlap_from) -> DataFrame:
    """Every month under every replicate; only months of the overlap differ between replicates."""
    value = F.when(F.col("year") < overlap_from, F.col("count_a").cast("double")).otherwise(F.col("celldays_b") * F.col("factor"))
    return months.join(factors, ["region", "season"]).withColumn("value", value)


def band(series: DataFrame, keys: list[str], value: str = "value", lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Exact percentiles over replicates, nulls left out."""
    q = F.percentile(value, F.array(F.lit(lo), F.lit(hi)))
    return series.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def annual_rollup(months: DataFrame, series: DataFrame) -> DataFrame:
    """Yearly totals by region and for all, with intervals of the totals: sums within replicates first, percentiles after.

    Flags drifted and gap, where months have them, hold for a year if for any of its months.
    """
    flags = [F.bool_or(c).alias(c) for c in ("drifted", "gap") if c in months.columns]
    flat = months.groupingSets([["year", "region"], ["year"]], "year", "region").agg(
        *flags, F.count_distinct("month").cast("int").alias("months"), F.sum("count_a").alias("count_a"), F.sum("naive").alias("naive"), F.sum(F.bround("harmonized", 1)).alias("harmonized"))
    flat = flat.withColumn("region", F.coalesce("region", F.lit("all")))
    sums = series.groupingSets([["rep", "year", "region"], ["rep", "year"]], "rep", "year", "region").agg(F.sum("value").alias("value"))
    sums = sums.withColumn("region", F.coalesce("region", F.lit("all")))
    return flat.join(band(sums, ["year", "region"]), ["year", "region"])


def jump(values: DataFrame, before: tuple[int, int], after: tuple[int, int], columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean yearly sum after, over mean yearly sum before, for each column."""
    yearly = values.groupBy(*keys, "year").agg(*(F.sum(c).alias(c) for c in columns))
    mean = lambda c, span: F.avg(F.when(F.col("year").between(*span), F.col(c)))
    return yearly.groupBy(*keys).agg(*(F.try_divide(mean(c, after), mean(c, before)).alias(f"jump_{c}") for c in columns))


def jump_interval(series: DataFrame, before: tuple[int, int], after: tuple[int, int], value: str = "value", lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """One row: the interval of jump() over replicates (rep)."""
    jumps = jump(series, before, after, [value], ("rep",))
    q = F.percentile(f"jump_{value}", F.array(F.lit(lo), F.lit(hi)))
    return jumps.agg(q.alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
