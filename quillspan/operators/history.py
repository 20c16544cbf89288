"""Histories of cells: dense panels, the calibration curve, flags, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.config import CONFIG, Config
from quillspan.operators.counts import cell_days
from quillspan.operators.grid import with_cells

CELL = ["ci", "cj"]


def season_table(df: DataFrame, grid: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Each cell in each season: count_a, raw_b, celldays_b (these two null before the overlap).

    df holds the detections of the season wanted; fine cells nest in cells, so
    a day counts once per fine cell.
    """
    keys = [*CELL, "year"]
    placed = with_cells(df, cfg.cell_step)
    raw = placed.groupBy(*keys).agg(F.count_if(F.col("sensor") == "A").alias("count_a"), F.count_if(F.col("sensor") == "B").alias("raw_b"))
    days = cell_days(placed.filter("sensor = 'B'"), cfg.fine_step).groupBy(*keys).agg(F.count("*").alias("celldays_b"))
    spine = grid.select(*CELL).distinct().withColumn("year", F.explode(F.sequence(F.lit(cfg.first_year), F.lit(cfg.last_year))))
    out = spine.join(raw, keys, "left").join(days, keys, "left").withColumn("count_a", F.coalesce("count_a", F.lit(0)))
    for c in ("raw_b", "celldays_b"):
        out = out.withColumn(c, F.when(F.col("year") >= cfg.overlap_from, F.coalesce(c, F.lit(0))))
    return out


def bin_of(value: Column, bins: tuple[int, ...] = CONFIG.bins) -> Column:
    """Number of the last bin that begins at or below the value; null counts as 0."""
    v = F.coalesce(value, F.lit(0))
    return sum((F.when(v >= b, 1).otherwise(0) for b in bins[1:]), F.lit(0)).cast("int")


def curve_fit(panel: DataFrame, bins: tuple[int, ...] = CONFIG.bins, keys: tuple[str, ...] = ()) -> DataFrame:
    """P(A >= 1) by bin of B, for each key: empty bins take the bin before, and p never falls. A leading empty bin stays null."""
    seen = panel.withColumn("bin", bin_of(F.col("celldays_b"), bins)).groupBy(*keys, "bin").agg(F.avg((F.col("count_a") >= 1).cast("double")).alias("p"))
    spine = (panel.select(*keys).distinct() if keys else panel.sparkSession.range(1).drop("id")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(bins) - 1))))
    order = Window.partitionBy(*keys or [F.lit(0)]).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # The largest so far is also the last one known where a bin is empty.
    return spine.join(seen, [*keys, "bin"], "left").withColumn("p", F.max("p").over(order))


def curve_apply(panel: DataFrame, curve: DataFrame, bins: tuple[int, ...] = CONFIG.bins, keys: tuple[str, ...] = ()) -> DataFrame:
    """panel with p; a curve has one row a bin."""
    return panel.withColumn("bin", bin_of(F.col("celldays_b"), bins)).join(curve, [*keys, "bin"], "left")


def cell_flags(panel: DataFrame, curve: DataFrame, factor: DataFrame, overlap_from: int = CONFIG.overlap_from, keys: tuple[str, ...] = ()) -> DataFrame:
    """active (3 places), active_naive and activity_eq (2 places). factor: one row, or one per key."""
    joined = curve_apply(panel, curve, keys=keys)
    joined = joined.join(factor, list(keys), "left") if keys else joined.crossJoin(F.broadcast(factor))
    early = F.col("year") < overlap_from
    flag = lambda c: (c >= 1).cast("double")
    return joined.select(
        *keys, *CELL, "year",
        F.bround(F.when(early, flag(F.col("count_a"))).otherwise(F.col("p")), 3).alias("active"),
        F.when(early, flag(F.col("count_a"))).otherwise(flag(F.col("raw_b"))).alias("active_naive"),
        F.bround(F.when(early, F.col("count_a").cast("double")).otherwise(F.col("celldays_b") * F.col("factor")), 2).alias("activity_eq"))


def brier_check(scored: DataFrame) -> DataFrame:
    """One row: brier, that of the mean share, skill, and both shares. scored: count_a and p."""
    y = (F.col("count_a") >= 1).cast("double")
    one = scored.agg(F.avg(F.pow(F.col("p") - y, F.lit(2))).alias("brier"), F.avg(y).alias("share_a"), F.avg("p").alias("share_p"))
    clim = F.col("share_a") * (1 - F.col("share_a"))
    return one.withColumn("brier_climatology", clim).withColumn("skill", 1 - F.try_divide(F.col("brier"), clim))


def reliability(scored: DataFrame) -> DataFrame:
    return scored.groupBy("bin").agg(F.count("*").alias("n"), F.max("p").alias("predicted"), F.avg((F.col("count_a") >= 1).cast("double")).alias("observed"))


def per_cell_sums(scored: DataFrame) -> DataFrame:
    """Cells with some activity: seasons with A, and expected seasons."""
    sums = scored.groupBy(*CELL).agg(F.count_if(F.col("count_a") >= 1).alias("y"), F.sum("p").alias("p"))
    return sums.filter("y > 0 or p > 0.5")


def streak(panel: DataFrame, flag: Column, out: str = "streak") -> DataFrame:
    """Per cell, how many seasons up to the last one the flag holds without a break."""
    back = Window.partitionBy(*CELL).orderBy(F.col("year").desc()).rowsBetween(Window.unboundedPreceding, 0)
    still = F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(back)
    return panel.withColumn("_still", still).groupBy(*CELL).agg(F.sum("_still").cast("int").alias(out))


def cell_summary(flags: DataFrame, cfg: Config = CONFIG, new_since: int = 2000, new_before_max: float = 0.5, new_since_min: float = 0.9, shares: tuple[float, float, float] = (0.75, 0.4, 0.15), jump: float = 0.25) -> DataFrame:
    """Per cell: sums by period, first and last likely season, streak, pattern, and whether it looks worse.

    Rounded sums feed the shares, as in reports: a season sum has one place, a
    period around new_since two.
    """
    n = cfg.last_year - cfg.first_year + 1
    early, late = cfg.overlap_from - cfg.first_year, cfg.last_year - cfg.overlap_from + 1
    # Sums at six places first: their last digits depend on the order of the rows.
    total = lambda c: F.round(F.sum(c), 6)
    when = lambda cond, c: total(F.when(cond, F.col(c)).otherwise(0.0))
    old, y = F.col("year") < cfg.overlap_from, F.col("year")
    likely = F.col("active") >= 0.5
    s = flags.groupBy(*CELL).agg(
        F.bround(total("active"), 1).alias("active_seasons"),
        F.sum("active_naive").cast("int").alias("active_seasons_naive"),
        F.bround(when(old, "active"), 1).alias("active_early"),
        F.bround(when(~old, "active"), 1).alias("active_late"),
        F.bround(when(y < new_since, "active"), 2).alias("active_before"),
        F.bround(when(y >= new_since, "active"), 2).alias("active_since"),
        when(~old, "active_naive").alias("naive_late"),
        F.bround(F.round(F.avg("activity_eq"), 6), 2).alias("mean_activity_eq"),
        F.min(F.when(likely, y)).alias("first_likely"),
        F.max(F.when(likely, y)).alias("last_likely"),
        # The streak in the same pass: the panel is dense, so it is the seasons after the last one that wasn't likely.
        F.max(F.when(~F.coalesce(likely, F.lit(False)), y)).alias("_broke"), F.max("year").alias("_last"), F.min("year").alias("_first"),
    )
    s = s.withColumn("streak", (F.col("_last") - F.coalesce("_broke", F.col("_first") - 1)).cast("int")).drop("_broke", "_last", "_first")
    share = F.col("active_seasons") / n
    early_share = F.col("active_early") / early
    pattern = F.when((F.col("active_before") < new_before_max) & (F.col("active_since") >= new_since_min), "new").when(share >= shares[0], "chronic").when(share >= shares[1], "recurring").when(share >= shares[2], "occasional").otherwise("rare")
    return (
        s.withColumn("share_active", F.bround(F.round(share, 6), 3)).withColumn("pattern", pattern)
        .withColumn("looks_worse_naive", F.col("naive_late") / late - early_share >= jump)
        .withColumn("looks_worse_harmonized", F.col("active_late") / late - early_share >= jump).drop("naive_late")
    )


def share_by_year(flags: DataFrame) -> DataFrame:
    return flags.groupBy("year").agg(F.avg("active").alias("harmonized"), F.avg("active_naive").alias("naive"))


def history_as_of(panel: DataFrame, months: DataFrame, origins: list[int], cfg: Config = CONFIG, clean_years: list[int] | None = None) -> DataFrame:
    """cell_flags() as known before each origin: curve and factor use overlap seasons (clean ones, if given) before it alone, all origins in one job."""
    table = F.broadcast(panel.sparkSession.createDataFrame([(t,) for t in origins], "origin int"))
    before = lambda df: df.filter((F.col("year") >= cfg.overlap_from) & (F.col("year").isin(clean_years) if clean_years else F.lit(True))).join(table, F.col("year") < F.col("origin"))
    curve = curve_fit(before(panel), cfg.bins, ("origin",))
    rows = before(months.filter("region = 'hills' and season = 'burn'"))
    factor = rows.groupBy("origin").agg((F.sum("count_a") / F.greatest(F.sum("celldays_b"), F.lit(1))).alias("factor"))
    return cell_flags(panel.crossJoin(table), curve, factor, cfg.overlap_from, ("origin",))
