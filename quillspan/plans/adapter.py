"""The driver's tables seen as detections of two sensors on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.counts import season_of, vegetation
from quillspan.operators.grid import with_cells
from quillspan.plans.base import part
from quillspan.staging import reading, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(reading(spark, f"{sf_dir}/{name}.parquet"))


def observations(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """One detection per line item (of `line`, a stream too); the supplier's nation places it."""
    supplier, nation = (table(spark, sf_dir, n) for n in ("supplier", "nation"))
    line = table(spark, sf_dir, "lineitem") if line is None else line
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    late = (F.col("l_linenumber") % 2 == 0) & (F.year("l_shipdate") >= 1998)
    slope = (F.col("l_partkey") % 40).cast("double")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        F.when(late, "B").otherwise("A").alias("sensor"),
        F.when(late, "S-NPP").when(F.col("l_orderkey") % 2 == 0, "Aqua").otherwise("Terra").alias("satellite"),
        (700 + (F.col("l_partkey") % 4) * 100 + F.col("l_suppkey") % 60).cast("int").alias("hhmm"),
        F.when(F.col("l_orderkey") % 3 == 0, "N").otherwise("D").alias("daynight"),
        F.when(F.col("n_regionkey").isin(0, 1), "hills").otherwise("plains").alias("region"),
        season_of(F.month("l_shipdate")).alias("season"), F.col("n_name").alias("district"),
        (F.lit(21.0005) + (F.col("l_partkey") % 200) * F.lit(0.002)).alias("lat"), (F.lit(92.0005) + (F.col("l_suppkey") % 20) * F.lit(0.02)).alias("lon"),
        (F.col("l_extendedprice") / 1000).alias("frp"),
        F.when(F.col("l_linenumber") == 1, "l").when(F.col("l_linenumber") == 2, "n").when(F.col("l_linenumber") == 3, "h").when(F.col("l_linenumber") == 4, "x").otherwise((F.col("l_partkey") % 100).cast("string")).alias("conf_raw"),
        F.when(F.col("l_discount") >= 0.095, 2).otherwise(0).alias("kind"),
        slope.alias("slope"), (slope >= 15).cast("double").alias("steep"),
        ((F.col("l_suppkey") % 50) * 20).cast("double").alias("people_r1"), ((F.col("l_suppkey") % 50) * 60).cast("double").alias("people_r2"),
    )


def season_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vegetation detections of the hills in the burn season: the columns that cells are made of, written once."""
    def make() -> DataFrame:
        kept = vegetation(observations(spark, sf_dir)).filter("region = 'hills' and season = 'burn'")
        return kept.select("id", "date", "year", "month", "sensor", "satellite", "region", "season", "kind", "lat", "lon", "slope", "steep", "people_r1", "people_r2")

    return staged(spark, sf_dir, "season_observations", make)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that detections fall in, with terrain and people reckoned from their numbers."""
    return terrain(staged(spark, sf_dir, "cells", lambda: with_cells(observations(spark, sf_dir), 0.02).select("ci", "cj").distinct()))


def terrain(cells: DataFrame) -> DataFrame:
    return cells.select(
        "ci", "cj", ((F.col("ci") * 7 + F.col("cj") * 3) % 40).cast("double").alias("slope_mean"), ((F.col("ci") * 13 + F.col("cj") * 5) % 400).cast("double").alias("population"),
        ((F.col("ci") * 11 + F.col("cj")) % 900).cast("double").alias("people_cell"), ((F.col("ci") * 17 + F.col("cj") * 29) % 700).cast("double").alias("elev_mean"), ((F.col("ci") * 5 + F.col("cj") * 11) % 100 / 100).alias("steep_frac"), F.concat(F.lit("d"), (F.col("ci") % 5).cast("string")).alias("district"))


part("obs", (), """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS date,
  CAST(extract(year FROM l_shipdate) AS INT) AS year, CAST(extract(month FROM l_shipdate) AS INT) AS month,
  CASE WHEN l_linenumber % 2 = 0 AND extract(year FROM l_shipdate) >= 1998 THEN 'B' ELSE 'A' END AS sensor,
  CASE WHEN l_linenumber % 2 = 0 AND extract(year FROM l_shipdate) >= 1998 THEN 'S-NPP' WHEN l_orderkey % 2 = 0 THEN 'Aqua' ELSE 'Terra' END AS satellite,
  CAST(700 + (l_partkey % 4) * 100 + l_suppkey % 60 AS INT) AS hhmm, CASE WHEN l_orderkey % 3 = 0 THEN 'N' ELSE 'D' END AS daynight,
  CASE WHEN n_regionkey IN (0, 1) THEN 'hills' ELSE 'plains' END AS region,
  CASE WHEN extract(month FROM l_shipdate) IN (2, 3, 4, 5) THEN 'burn' ELSE 'off' END AS season, n_name AS district,
  21.0005e0 + (l_partkey % 200) * 0.002e0 AS lat, 92.0005e0 + (l_suppkey % 20) * 0.02e0 AS lon, l_extendedprice / 1000 AS frp,
  CASE l_linenumber WHEN 1 THEN 'l' WHEN 2 THEN 'n' WHEN 3 THEN 'h' WHEN 4 THEN 'x' ELSE CAST(l_partkey % 100 AS VARCHAR) END AS conf_raw,
  CASE WHEN l_discount >= 0.095 THEN 2 ELSE 0 END AS kind, CAST(l_partkey % 40 AS DOUBLE) AS slope,
  CASE WHEN l_partkey % 40 >= 15 THEN 1.0e0 ELSE 0.0e0 END AS steep,
  CAST((l_suppkey % 50) * 20 AS DOUBLE) AS people_r1, CAST((l_suppkey % 50) * 60 AS DOUBLE) AS people_r2
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
part("veg", ("obs",), "SELECT * FROM obs WHERE kind = 0 AND (sensor = 'B' OR satellite = 'Aqua')")
part("placed", ("veg",), """
SELECT *, CAST(floor(lat / 0.02e0) AS BIGINT) AS ci, CAST(floor(lon / 0.02e0) AS BIGINT) AS cj,
  CAST(floor(lat / 0.01e0) AS BIGINT) AS fi, CAST(floor(lon / 0.01e0) AS BIGINT) AS fj FROM veg""")
part("hot", ("placed",), "SELECT * FROM placed WHERE region = 'hills' AND season = 'burn'")
part("grid", ("obs",), """
SELECT ci, cj, CAST((ci * 7 + cj * 3) % 40 AS DOUBLE) AS slope_mean, CAST((ci * 13 + cj * 5) % 400 AS DOUBLE) AS population,
  CAST((ci * 11 + cj) % 900 AS DOUBLE) AS people_cell, CAST((ci * 17 + cj * 29) % 700 AS DOUBLE) AS elev_mean, (ci * 5 + cj * 11) % 100 / 100 AS steep_frac, 'd' || (ci % 5) AS district
FROM (SELECT DISTINCT CAST(floor(lat / 0.02e0) AS BIGINT) AS ci, CAST(floor(lon / 0.02e0) AS BIGINT) AS cj FROM obs)""")
