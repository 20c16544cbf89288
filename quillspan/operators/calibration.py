"""Calibrate one record against the other on their overlap, and judge how well that predicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.config import CONFIG
from quillspan.functions.stats import correlation

#: Method -> (value that is scaled, keys of its ratio). "climatology" averages record A by its keys instead.
METHODS: dict[str, tuple[str, tuple[str, ...] | None]] = {
    "naive": ("raw_b", None),
    "climatology": ("climatology", ("region", "month")),
    "global_raw": ("raw_b", ()),
    "global_celldays": ("celldays_b", ()),
    "season": ("celldays_b", ("season",)),
    "region": ("celldays_b", ("region",)),
    "region_season": ("celldays_b", ("region", "season")),
}


def ratio(a: Column, b: Column) -> Column:
    """Ratio of sums, with a denominator of at least 1."""
    return F.sum(a) / F.greatest(F.sum(b), F.lit(1))


def ratio_by_group(months: DataFrame, keys: tuple[str, ...] = ("region", "season"), value: str = "celldays_b") -> DataFrame:
    return months.groupBy(*keys).agg(ratio(F.col("count_a"), F.col(value)).alias("factor"))


def ratio_sets(months: DataFrame, value: str = "celldays_b") -> DataFrame:
    """Ratios of all groupings of region and season in one pass; level is 0 for both, 1 region, 2 season, 3 none."""
    sets = months.groupingSets([["region", "season"], ["region"], ["season"], []], "region", "season")
    return sets.agg(F.grouping_id().cast("int").alias("level"), ratio(F.col("count_a"), F.col(value)).alias("factor")).select("level", "region", "season", "factor")


def per_method(months: DataFrame) -> DataFrame:
    """Each month once per method, with the method's value and the key of its group."""
    def one(name: str) -> Column:
        value, keys = METHODS[name]
        v = F.lit(1) if value == "climatology" else F.col(value)
        return F.struct(F.lit(name).alias("method"), v.cast("double").alias("value"), F.concat_ws("|", F.lit(name), *(F.col(k).cast("string") for k in keys or ())).alias("key"))

    return months.withColumn("m", F.explode(F.array(*map(one, METHODS)))).select("year", "month", "region", "season", F.col("count_a").cast("double").alias("actual"), "m.*")


def _predicted(rows: DataFrame, sum_a: Column, sum_v: Column, seen: Column) -> DataFrame:
    """Apply ratios; a group never seen in training has ratio 1, or a climatology of 0."""
    factor = F.when(F.coalesce(seen, F.lit(0)) == 0, F.when(F.col("method") == "climatology", 0.0).otherwise(1.0)).otherwise(sum_a / F.greatest(sum_v, F.lit(1.0)))
    pred = F.when(F.col("method") == "naive", F.col("value")).otherwise(F.col("value") * factor)
    return rows.select("method", "year", "month", "region", "season", "actual", pred.alias("pred"))


def predict(train: DataFrame, test: DataFrame) -> DataFrame:
    """Every method fitted on train and applied to test."""
    fit = per_method(train).groupBy("key").agg(F.sum("actual").alias("sa"), F.sum("value").alias("sv"), F.count("*").alias("n"))
    return _predicted(per_method(test).join(fit, "key", "left"), F.col("sa"), F.col("sv"), F.col("n"))


def leave_one_year_out(months: DataFrame) -> DataFrame:
    """Every method fitted on all years but the predicted one: the year's own sums are taken from the totals."""
    rows = per_method(months)
    yearly = rows.groupBy("key", "year").agg(F.sum("actual").alias("a"), F.sum("value").alias("v"), F.count("*").alias("n"))
    total = yearly.groupBy("key").agg(F.sum("a").alias("ta"), F.sum("v").alias("tv"), F.sum("n").alias("tn"))
    rest = yearly.join(total, "key").select("key", "year", (F.col("ta") - F.col("a")).alias("sa"), (F.col("tv") - F.col("v")).alias("sv"), (F.col("tn") - F.col("n")).alias("left"))
    return _predicted(rows.join(rest, ["key", "year"], "left"), F.col("sa"), F.col("sv"), F.col("left"))


def percent(a: Column, b: Column) -> Column:
    """Difference of a from b in percent; null where b is 0."""
    return (F.try_divide(a, b) - 1) * 100


def absolute_percent(true: Column, pred: Column) -> Column:
    return F.median(F.abs(pred / F.greatest(true, F.lit(1.0)) - 1)) * 100


def score_overall(predicted: DataFrame) -> DataFrame:
    """Per method: monthly_mae, monthly_r2, bias_pct, and the median yearly error by region and for all."""
    mean = predicted.groupBy("method").agg(F.avg("actual").alias("mean"))
    monthly = predicted.join(mean, "method").groupBy("method").agg(
        F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("monthly_mae"),
        (1 - F.try_divide(F.sum(F.pow(F.col("pred") - F.col("actual"), F.lit(2))), F.sum(F.pow(F.col("actual") - F.col("mean"), F.lit(2))))).alias("monthly_r2"),
        percent(F.sum("pred"), F.sum("actual")).alias("bias_pct"),
    )
    regional = predicted.groupBy("method", "year", "region").agg(F.sum("actual").alias("t"), F.sum("pred").alias("p"))
    national = regional.groupBy("method", "year").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    for frame, name in ((regional, "regional_err_pct"), (national, "national_err_pct")):
        monthly = monthly.join(frame.groupBy("method").agg(absolute_percent(F.col("t"), F.col("p")).alias(name)), "method")
    return monthly


def score_by_group(predicted: DataFrame) -> DataFrame:
    """Per method, region and season: yearly_r (null under three years or without spread), mean, bias and median error."""
    yearly = predicted.groupBy("method", "region", "season", "year").agg(F.sum("actual").alias("t"), F.sum("pred").alias("p"))
    spread = (F.count("*") > 2) & (F.stddev_samp("p") > 0) & (F.stddev_samp("t") > 0)
    return yearly.groupBy("method", "region", "season").agg(
        F.when(spread, correlation("t", "p")).alias("yearly_r"),
        F.avg("t").alias("mean_true"),
        percent(F.sum("p"), F.sum("t")).alias("bias_pct"),
        absolute_percent(F.col("t"), F.col("p")).alias("median_err_pct"),
    )


def harmonize(months: DataFrame, factors: DataFrame, overlap_from: int = CONFIG.overlap_from, keys: tuple[str, ...] = ("region", "season"), out: str = "harmonized") -> DataFrame:
    """Record A before the overlap, scaled record B from then on; null for groups without a factor."""
    joined = months.join(factors, list(keys), "left")
    value = F.when(F.col("year") < overlap_from, F.col("count_a").cast("double")).otherwise(F.col("celldays_b") * F.col("factor"))
    return joined.withColumn(out, value).drop("factor")


def naive_stitch(months: DataFrame, overlap_from: int = CONFIG.overlap_from) -> DataFrame:
    return months.withColumn("naive", F.when(F.col("year") < overlap_from, F.col("count_a")).otherwise(F.col("raw_b")))


def per_year_ratio(months: DataFrame, overlap_from: int = CONFIG.overlap_from) -> DataFrame:
    return ratio_by_group(months.filter(F.col("year") >= overlap_from), ("year", "region", "season"))


def sensitivity(months: DataFrame, subsets: dict[str, list[int]]) -> DataFrame:
    """Factors fitted on named sets of years, all in one pass."""
    spark = months.sparkSession
    sets = spark.createDataFrame([(k, y) for k, ys in subsets.items() for y in ys], "subset string, year int")
    return months.join(F.broadcast(sets), "year").groupBy("subset", "region", "season").agg(ratio(F.col("count_a"), F.col("celldays_b")).alias("factor"))
