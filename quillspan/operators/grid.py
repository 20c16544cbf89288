"""Regular grids: cells of points, neighbourhoods of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(coordinate: Column | str, step: float) -> Column:
    """Number of the cell, counted from 0 at coordinate 0; negative coordinates go down."""
    c = F.col(coordinate) if isinstance(coordinate, str) else coordinate
    return F.floor(c / F.lit(step)).cast("long")


def centre(number: Column | str, step: float) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return (n + F.lit(0.5)) * F.lit(step)


def bounds(i: Column | str, j: Column | str, step: float) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a cell (i counts latitudes, j longitudes)."""
    i, j = (F.col(c) if isinstance(c, str) else c for c in (i, j))
    return j * F.lit(step), i * F.lit(step), (j + 1) * F.lit(step), (i + 1) * F.lit(step)


def with_cells(df: DataFrame, step: float, names: tuple[str, str] = ("ci", "cj"), lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn(names[0], cell(lat, step)).withColumn(names[1], cell(lon, step))


def offsets(radius: int, centre_too: bool = True) -> Column:
    """All (di, dj) up to radius, as an array to explode."""
    around = range(-radius, radius + 1)
    return F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in around for b in around if centre_too or a or b))


def dilate(cells: DataFrame, names: tuple[str, str] = ("fi", "fj"), radius: int = 1) -> DataFrame:
    """The cells and all their neighbours, once each."""
    i, j = names
    spread = cells.select(i, j).distinct().select(i, j, F.explode(offsets(radius)).alias("o"))
    return spread.select((F.col(i) + F.col("o.di")).alias(i), (F.col(j) + F.col("o.dj")).alias(j)).distinct()


def neighbour_mean(grid: DataFrame, value: str, out: str, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """grid with the mean of value over the eight cells around each; cells that are missing or null count as 0."""
    keys = [*extra_keys, "ci", "cj"]
    given = grid.filter(F.col(value) != 0).select(*keys, F.col(value).alias("_v"), F.explode(offsets(1, False)).alias("o"))
    sums = given.groupBy(*extra_keys, (F.col("ci") + F.col("o.di")).alias("ci"), (F.col("cj") + F.col("o.dj")).alias("cj")).agg((F.sum("_v") / 8).alias(out))
    return grid.join(sums, keys, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def members(points: DataFrame, cells: DataFrame, keys: tuple[str, str], inside: bool = True) -> DataFrame:
    """Points whose cell is (or is not) among cells."""
    return points.join(cells.select(*keys).distinct(), list(keys), "left_semi" if inside else "left_anti")
