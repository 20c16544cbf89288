"""Leakage-free features: every season's row looks at earlier seasons alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.config import CONFIG, Config
from quillspan.operators.grid import neighbour_mean, with_cells

CELL = ["ci", "cj"]
#: What the grid tells of a cell, whatever the season.
STATIC = ["elev_mean", "slope_mean", "steep_frac"]
FEATURES = ["lag1_days", "lag1", "lag2", "lag3", "freq", "freq_heavy", "mean_days", "years_since_burn", "nbr_lag1", "nbr_freq", "long_share", "long_activity", "long_recent3", *STATIC, "log_pop"]


def fire_days(df: DataFrame, step: float = CONFIG.cell_step) -> DataFrame:
    """Distinct days with a detection, per cell and year."""
    return with_cells(df, step).select(*CELL, "year", "date").distinct().groupBy(*CELL, "year").agg(F.count("*").cast("int").alias("days"))


def features(grid: DataFrame, days: DataFrame, history: DataFrame, years: list[int], cfg: Config = CONFIG) -> DataFrame:
    """Features of every cell for every target year, from seasons before it.

    days: ci, cj, year, days of record B. history: origin, ci, cj, year,
    active, activity_eq, as history_as_of() has them: the history as it was
    known before each target year, which is its origin. grid: ci, cj,
    population and STATIC. A dense panel and window frames that end one season
    before the row serve all target years at once.
    """
    span = F.explode(F.sequence(F.lit(cfg.first_year), F.lit(max(years))))
    panel = grid.select(*CELL, *STATIC, F.log1p("population").alias("log_pop")).withColumn("year", span)
    panel = panel.join(days, [*CELL, "year"], "left").withColumn("days", F.when(F.col("year") >= cfg.overlap_from, F.coalesce("days", F.lit(0))))
    order = Window.partitionBy(*CELL).orderBy("year")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    lag = lambda k: F.coalesce(F.lag("days", k).over(order), F.lit(0))
    last = F.max(F.when(F.col("days") > 0, F.col("year"))).over(past)
    mean = lambda c: F.coalesce(F.avg(c).over(past), F.lit(0.0))
    known = F.col("days").isNotNull()
    out = panel.select(
        *CELL, "year", *STATIC, "log_pop", "days",
        lag(1).alias("lag1_days"), *((lag(k) > 0).cast("int").alias(f"lag{k}") for k in (1, 2, 3)),
        mean(F.when(known, (F.col("days") > 0).cast("double"))).alias("freq"),
        mean(F.when(known, (F.col("days") >= cfg.heavy_days).cast("double"))).alias("freq_heavy"),
        mean("days").alias("mean_days"),
        F.coalesce(F.col("year") - last, F.lit(cfg.never_burned)).alias("years_since_burn"),
    ).filter(F.col("year").isin(years))
    known_then = history.filter((F.col("year") < F.col("origin")) & F.col("origin").isin(years)).groupBy(*CELL, F.col("origin").alias("year")).agg(
        F.avg("active").alias("long_share"), F.avg("activity_eq").alias("long_activity"), F.avg(F.when(F.col("year") >= F.col("origin") - 3, F.col("active"))).alias("long_recent3"))
    out = out.join(known_then, [*CELL, "year"], "left").fillna(0.0, ["long_share", "long_activity", "long_recent3"])
    out = neighbour_mean(out, "lag1", "nbr_lag1", ("year",))
    return neighbour_mean(out, "freq", "nbr_freq", ("year",))


def dataset(grid: DataFrame, days: DataFrame, history: DataFrame, years: list[int], cfg: Config = CONFIG) -> DataFrame:
    """features() with the label: whether the target season itself burned heavily."""
    out = features(grid, days, history, years, cfg)
    return out.withColumn("burned", (F.coalesce("days", F.lit(0)) >= cfg.heavy_days).cast("int")).drop("days")


def rule_scores(frame: DataFrame) -> DataFrame:
    """The three rules' scores; higher means likelier to burn heavily."""
    return (
        frame.withColumn("score_last_year", F.col("lag1_days").cast("double"))
        .withColumn("score_history", F.col("freq_heavy") + 1e-3 * F.col("mean_days"))
        .withColumn("score_long_history", F.col("long_activity"))
    )


def boosted(columns: list[str] | None = None, rounds: int = 300, depth: int = 5, step: float = 0.05, seed: int = 0):
    """An unfitted pipeline of gradient-boosted trees on the features, for the label burned."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=columns or FEATURES, outputCol="features")
    return Pipeline(stages=[assemble, GBTClassifier(labelCol="burned", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)])


def with_boosted(model, frame: DataFrame) -> DataFrame:
    """frame with score_boosted, the probability that the fitted pipeline gives."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(frame)
    return scored.withColumn("score_boosted", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def boosted_scores(train: DataFrame, test: DataFrame, columns: list[str] | None = None, **settings) -> DataFrame:
    """test with score_boosted, the probability from gradient-boosted trees fitted on train (label burned)."""
    return with_boosted(boosted(columns, **settings).fit(train), test)


def boosted_by_origin(data: DataFrame, origins: list[int], **settings) -> DataFrame:
    """Rows of the origins with score_boosted from a model fitted on seasons before each; a season without earlier rows of both labels has 0.

    One fit an origin, as a fit has one training set. data: (origin, features,
    year, burned); a row is used for training by every later origin.
    """
    out = None
    for t in origins:
        train, test = data.filter((F.col("origin") == t) & (F.col("year") < t)), data.filter((F.col("origin") == t) & (F.col("year") == t))
        both = train.agg(F.min("burned"), F.max("burned")).first()
        part = boosted_scores(train, test, **settings) if tuple(both) == (0, 1) else test.withColumn("score_boosted", F.lit(0.0))
        out = part if out is None else out.unionByName(part)
    return out
