"""Before and after images as long tables: reflectance, composites of clear scenes, burn scars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.operators.ranking import blind_codes, same_rows, seeded_sample


def search_scenes(scenes: DataFrame, max_cloud: float = 70.0, limit: int = 40) -> DataFrame:
    """The clearest scenes of each cell and time window, with their order."""
    order = Window.partitionBy("cell", "window").orderBy("cloud", "scene")
    return scenes.filter(F.col("cloud") < max_cloud).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def reflectance(dn: Column, scale: Column, offset: Column, applied: Column) -> Column:
    """Digital numbers as reflectance: 0 is no data, without a scale the codes stay, an offset counts unless applied already."""
    moved = dn * scale + F.when(F.coalesce(applied, F.lit(False)), 0.0).otherwise(F.coalesce(offset, F.lit(0.0)))
    return F.when(scale.isNull(), dn.cast("double")).otherwise(F.when(dn != 0, moved))


def same_projection(scenes: DataFrame) -> DataFrame:
    """Scenes (cell, window, scene, place, epsg) in the projection of the first of their cell and window, with places from 1 among these. Only they lie on one lattice of pixels."""
    order = Window.partitionBy("cell", "window").orderBy("place", "scene")
    kept = scenes.withColumn("_first", F.first("epsg").over(order)).filter(F.col("epsg").eqNullSafe(F.col("_first"))).drop("_first")
    return kept.withColumn("place", F.row_number().over(order))


def choose_scenes(pixels: DataFrame, valid: list[int], keep: int = 3, clear: float = 0.9, least: float = 0.05, candidates: int = 8) -> DataFrame:
    """cell, window, scene of the scenes to use. pixels: cell, window, scene, place, scl, and epsg where scenes differ in it: then those of the first one's projection count.

    Scenes are looked at by place until `keep` of them are over `clear` clear;
    of those looked at, the `keep` clearest with at least `least` remain.
    """
    if "epsg" in pixels.columns:
        one = same_projection(pixels.select("cell", "window", "scene", "place", "epsg").distinct()).drop("epsg")
        pixels = pixels.drop("place").join(one, ["cell", "window", "scene"])
    share = pixels.filter(F.col("place") <= candidates).groupBy("cell", "window", "scene", "place").agg(F.avg(F.coalesce(F.col("scl").isin(valid), F.lit(False)).cast("double")).alias("clear"))
    order = Window.partitionBy("cell", "window")
    seen = F.coalesce(F.sum((F.col("clear") > clear).cast("int")).over(order.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    looked = share.withColumn("seen", seen).filter((F.col("seen") < keep) & (F.col("clear") >= least))
    return looked.withColumn("rank", F.row_number().over(order.orderBy(F.col("clear").desc(), "place"))).filter(F.col("rank") <= keep).select("cell", "window", "scene")


def nbr_composite(pixels: DataFrame, valid: list[int], **choice) -> DataFrame:
    """Median burn ratio per cell, window and pixel over the chosen scenes. pixels also hold row, col, nir, swir."""
    chosen = choose_scenes(pixels, valid, **choice)
    nbr = F.when(F.col("scl").isin(valid), F.try_divide(F.col("nir") - F.col("swir"), F.col("nir") + F.col("swir")))
    return pixels.join(chosen, ["cell", "window", "scene"]).groupBy("cell", "window", "row", "col").agg(F.median(nbr).alias("nbr"))


def dnbr_cell(composites: DataFrame, pixels_per_cell: int, min_clear: float = 0.3, scar: float = 0.27, visible: float = 0.05, thresholds: tuple[float, ...] = (0.10, 0.20, 0.27, 0.44), steep: DataFrame | None = None) -> DataFrame:
    """Per cell: clear_share, shares of scar pixels at each threshold, medians, verdict. Windows are 'pre' and 'post'.

    steep (cell, row, col, steep boolean) adds the steep share of scar pixels.
    """
    of = lambda w: F.max(F.when(F.col("window") == w, F.col("nbr")))
    both = composites.groupBy("cell", "row", "col").agg(of("pre").alias("pre"), of("post").alias("post")).withColumn("d", F.col("pre") - F.col("post"))
    if steep is not None:
        both = both.join(steep, ["cell", "row", "col"], "left")
    seen = F.count("d")
    part = lambda c: F.try_divide(F.count_if(c).cast("double"), seen)
    out = both.groupBy("cell").agg(
        (seen / pixels_per_cell).alias("clear_share"), *(part(F.col("d") >= t).alias(f"scar_share_{round(t * 100):02d}") for t in thresholds),
        part(F.col("d") >= scar).alias("scar_share"), F.median("d").alias("dnbr_median"),
        *((F.avg(F.when(F.col("d") >= scar, F.col("steep").cast("double"))).alias("scar_on_steep_share"),) if steep is not None else ()))
    verdict = F.when(F.col("clear_share") < min_clear, "no clear imagery").when(F.col("scar_share") >= visible, "scar visible").otherwise("no clear scar")
    return out.withColumn("verdict", verdict)


def threshold_matrix(cells: DataFrame, thresholds: tuple[int, ...] = (10, 20, 27, 44), shares: tuple[float, ...] = (0.02, 0.05, 0.10)) -> DataFrame:
    """Per group, threshold and share: how many cells have that share of scar pixels at that threshold."""
    flat = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"scar_share_{t:02d}").alias("v")) for t in thresholds)))
    long = cells.filter("verdict != 'no clear imagery'").select("group", flat.alias("x")).select("group", "x.*").withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return long.groupBy("group", "threshold", "share").agg(F.count_if(F.col("v") >= F.col("share")).alias("cells"))


def group_summary(cells: DataFrame) -> DataFrame:
    clear = F.col("verdict") != "no clear imagery"
    med = lambda c: F.median(F.when(clear, F.col(c)))
    return cells.groupBy("group").agg(F.count("*").alias("cells"), F.count_if(clear).alias("with_imagery"), F.count_if(F.col("verdict") == "scar visible").alias("visible"), med("scar_share").alias("scar_share_median"), med("clear_share").alias("clear_share_median"))


def sample_cells(cells: DataFrame, recent: DataFrame, n: int, seed: int, min_slope: float = 15.0) -> DataFrame:
    """ci, cj, group: the n best-ranked cells with fires (priority), n other cells with fires (fire) and n steep cells without recent ones (control).

    cells: the observed list, with rank, fire_days and slope_p90. recent: ci, cj
    of cells with fires of late. Fewer than n cells of a kind give fewer rows.
    """
    keys = ["ci", "cj"]
    burned = cells.filter("fire_days > 0")
    first = burned.orderBy("rank", *keys).limit(n).select(*keys)
    others = seeded_sample(burned.join(first, keys, "left_anti"), n, seed, keys).select(*keys)
    calm = cells.filter(F.col("slope_p90") >= min_slope).join(recent.select(*keys).distinct(), keys, "left_anti")
    control = seeded_sample(calm, n, seed, keys).select(*keys)
    groups = [(first, "priority"), (others, "fire"), (control, "control")]
    out = None
    for rows, name in groups:
        part = rows.withColumn("group", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def blind_kit(checked: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A sheet of codes to fill in (code, visible, notes), and the key that says which cell and group a code stands for."""
    coded = blind_codes(checked.select("ci", "cj", "group"), seed, ["ci", "cj"])
    blank = F.lit("")
    return coded.select("code", blank.alias("visible"), blank.alias("notes")).orderBy("code"), coded


def still_current(checked: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: whether the cells checked as priority are those that would be chosen now."""
    best = lambda df: df.filter("group = 'priority'").select("ci", "cj")
    return same_rows(best(checked), best(sample)).select(F.col("equal").alias("sample_matches_list"))
