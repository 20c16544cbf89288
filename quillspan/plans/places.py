"""Queries over places, rasters, images and the recent window."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import stats
from quillspan.operators import imagery, live, projection, spatial
from quillspan.operators.grid import with_cells
from quillspan.plans.adapter import grid, observations, table
from quillspan.plans.base import Book, part, q, r, rounded

BOOK = Book()
SIZE = 40  # columns of the raster that events fill row by row
PLACES = [(0, "north", 21.35, 92.1), (1, "south", 21.02, 92.3), (2, "(unnamed)", 21.2, 92.2), (3, "west", 21.2, 92.02), (4, "east", 21.2, 92.02)]
VALUES = ", ".join(f"({i}, '{n}', {a}e0, {o}e0)" for i, n, a, o in PLACES)
TRIANGLE = [(0, [[(92.0, 21.0), (92.25, 21.0), (92.0, 21.4), (92.0, 21.0)]]), (1, [[(92.2, 21.1), (92.4, 21.1), (92.4, 21.3), (92.2, 21.3), (92.2, 21.1)], [(92.26, 21.16), (92.34, 21.16), (92.34, 21.24), (92.26, 21.24), (92.26, 21.16)]])]
EDGES = ", ".join(f"({p}, {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for p, rings in TRIANGLE for ring in rings for a, b in zip(ring, ring[1:], strict=False))

part("pts", ("obs",), "SELECT CAST(round(lat * 10000) AS BIGINT) * 10000000 + CAST(round(lon * 10000) AS BIGINT) AS pid, lat, lon FROM (SELECT DISTINCT lat, lon FROM obs)")
part("places", (), f"SELECT * FROM (VALUES {VALUES}) v(place_id, name, lat, lon)")
part("edges", (), f"SELECT * FROM (VALUES {EDGES}) v(poly_id, x1, y1, x2, y2)")
part("raster", (), f"SELECT event_id // {SIZE} AS row, event_id % {SIZE} AS col, CAST(floor(value * 4) AS DOUBLE) AS value FROM events")
part("sloped", ("raster",), """
SELECT row, col, value, degrees(atan(sqrt((dx / 30) ** 2 + (dy / 30) ** 2))) AS slope FROM (
  SELECT row, col, value,
    CASE WHEN lag(value) OVER c IS NULL THEN lead(value) OVER c - value WHEN lead(value) OVER c IS NULL THEN value - lag(value) OVER c ELSE (lead(value) OVER c - lag(value) OVER c) / 2 END AS dx,
    CASE WHEN lag(value) OVER r IS NULL THEN lead(value) OVER r - value WHEN lead(value) OVER r IS NULL THEN value - lag(value) OVER r ELSE (lead(value) OVER r - lag(value) OVER r) / 2 END AS dy
  FROM raster WINDOW c AS (PARTITION BY row ORDER BY col), r AS (PARTITION BY col ORDER BY row))""")
part("spots", (), f"SELECT p_partkey AS pid, p_partkey * 7 % 260 AS row, p_partkey * 11 % {SIZE + 4} AS col FROM part")
part("scenes", (), """
SELECT cell, win, scene, scene AS place, p // 5 AS row, p % 5 AS col, value % 100 + 20 + CASE WHEN win = 'pre' THEN 60 ELSE 0 END AS nir, CAST((user_id * 29 + p * 3) % 90 + 10 AS DOUBLE) AS swir,
  CASE WHEN (p + scene * 3 + cell) % 20 < scene % 4 * 3 THEN 9 ELSE 4 END AS scl
FROM (SELECT value, user_id, event_id // 300 AS cell, CASE WHEN event_id // 150 % 2 = 0 THEN 'pre' ELSE 'post' END AS win, event_id // 25 % 6 AS scene, event_id % 25 AS p FROM events)""")
part("clear", ("scenes",), """
SELECT cell, win, scene, place, clear, coalesce(sum(CAST(clear > 0.9 AS INT)) OVER (PARTITION BY cell, win ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
FROM (SELECT cell, win, scene, place, avg(CASE WHEN scl = 4 THEN 1.0e0 ELSE 0.0e0 END) AS clear FROM scenes WHERE place <= 8 GROUP BY ALL)""")
part("nbr", ("scenes", "clear"), """
SELECT s.cell, s.win, row, col, median(CASE WHEN scl = 4 THEN (nir - swir) / nullif(nir + swir, 0) END) AS nbr
FROM scenes s JOIN (SELECT * FROM clear WHERE seen < 3 AND clear >= 0.05 QUALIFY row_number() OVER (PARTITION BY cell, win ORDER BY clear DESC, place) <= 3) k ON s.cell = k.cell AND s.win = k.win AND s.scene = k.scene GROUP BY ALL""")
part("dnbr", ("nbr",), """
SELECT cell, clear_share, s10, s20, s27, s44, dm, CASE WHEN clear_share < 0.3 THEN 'no clear imagery' WHEN s27 >= 0.05 THEN 'scar visible' ELSE 'no clear scar' END AS verdict FROM (
  SELECT cell, count(d) / 25 AS clear_share, count(*) FILTER (d >= 0.10) / nullif(count(d), 0) AS s10, count(*) FILTER (d >= 0.20) / nullif(count(d), 0) AS s20, count(*) FILTER (d >= 0.27) / nullif(count(d), 0) AS s27, count(*) FILTER (d >= 0.44) / nullif(count(d), 0) AS s44, median(d) AS dm
  FROM (SELECT cell, row, col, max(nbr) FILTER (win = 'pre') - max(nbr) FILTER (win = 'post') AS d FROM nbr GROUP BY ALL) GROUP BY cell)""")
part("static", ("obs",), "SELECT DISTINCT fi + a AS fi, fj + b AS fj FROM (SELECT DISTINCT CAST(floor(lat / 0.01e0) AS BIGINT) AS fi, CAST(floor(lon / 0.01e0) AS BIGINT) AS fj FROM obs WHERE kind <> 0) CROSS JOIN (VALUES (-1), (0), (1)) x(a) CROSS JOIN (VALUES (-1), (0), (1)) y(b)")
part("hotspots", (), "SELECT DISTINCT CAST(floor((21.0005e0 + (s_suppkey % 200) * 0.002e0) / 0.01e0) AS BIGINT) AS fi, CAST(floor((92.0005e0 + (s_suppkey % 20) * 0.02e0) / 0.01e0) AS BIGINT) AS fj FROM supplier WHERE s_acctbal < -500")
part("still", ("hotspots",), "SELECT DISTINCT fi + a AS fi, fj + b AS fj FROM hotspots, range(-1, 2) x(a), range(-1, 2) y(b)")
part("newest", ("obs",), "SELECT max(date) AS newest FROM obs WHERE date <= CAST('2001-03-15' AS DATE)")
part("week", ("obs", "still", "grid", "newest"), """
SELECT o.*, g.slope_mean, g.population, CAST(floor(o.lat / 0.02e0) AS BIGINT) AS ci, CAST(floor(o.lon / 0.02e0) AS BIGINT) AS cj, CASE WHEN g.ci % 9 = 0 THEN ['2001'] END AS seasons,
  g.ci IS NOT NULL AS hills, g.ci IS NOT NULL AND (g.slope_mean >= 15 AND g.population >= 200 OR g.ci % 9 = 0) AS chk
FROM obs o LEFT JOIN (SELECT * FROM grid WHERE ci % 2 = 0 OR ci % 9 = 0) g ON floor(o.lat / 0.02e0) = g.ci AND floor(o.lon / 0.02e0) = g.cj
WHERE date > (SELECT newest - 7 FROM newest) AND date <= (SELECT newest FROM newest) AND sensor = 'B' AND NOT EXISTS (SELECT 1 FROM still s WHERE s.fi = floor(o.lat / 0.01e0) AND s.fj = floor(o.lon / 0.01e0))""")


def spots_of(spark, sf_dir):
    """The positions of all detections, once each, numbered by their coordinates."""
    number = F.round(F.col("lat") * 10000).cast("long") * 10_000_000 + F.round(F.col("lon") * 10000).cast("long")
    return observations(spark, sf_dir).select("lat", "lon").distinct().select(number.alias("pid"), "lat", "lon")


def places(spark):
    return spark.createDataFrame(PLACES, "place_id int, name string, lat double, lon double")


def polygons(spark):
    rows = [(p, [[list(map(float, xy)) for xy in ring] for ring in rings]) for p, rings in TRIANGLE]
    return spark.createDataFrame(rows, "poly_id int, rings array<array<array<double>>>")


def raster(spark, sf_dir):
    """Events in their order as pixels of a raster SIZE columns wide."""
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / SIZE).cast("long").alias("row"), (F.col("event_id") % SIZE).alias("col"), F.floor(F.col("value") * 4).cast("double").alias("value"))


def sloped(spark, sf_dir):
    return spatial.slope(raster(spark, sf_dir), F.lit(30.0))


def spots(spark, sf_dir):
    """Parts scattered over the raster; some fall beside it."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("pid"), (k * 7 % 260).alias("row"), (k * 11 % (SIZE + 4)).alias("col"))


def scenes(spark, sf_dir):
    """Events as pixels: 300 in a row are a cell's two windows of six scenes of 25 pixels."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    whole = lambda c: F.floor(c).cast("long")
    e = e.select("value", "user_id", whole(k / 300).alias("cell"), F.when(whole(k / 150) % 2 == 0, "pre").otherwise("post").alias("window"), (whole(k / 25) % 6).alias("scene"), (k % 25).alias("p"))
    c, s, p = F.col("cell"), F.col("scene"), F.col("p")
    return e.select(
        "cell", "window", "scene", s.alias("place"), whole(p / 5).alias("row"), (p % 5).alias("col"), (F.col("value") % 100 + 20 + F.when(F.col("window") == "pre", 60).otherwise(0)).alias("nir"),
        ((F.col("user_id") * 29 + p * 3) % 90 + 10).cast("double").alias("swir"), F.when((p + s * 3 + c) % 20 < s % 4 * 3, 9).otherwise(4).alias("scl"))


def composites(spark, sf_dir):
    return imagery.nbr_composite(scenes(spark, sf_dir), [4])


def checked(spark, sf_dir):
    return imagery.dnbr_cell(composites(spark, sf_dir), 25)


def static(spark, sf_dir):
    return live.static_cells(observations(spark, sf_dir))


def still(spark, sf_dir):
    """Cells around suppliers with very low balances, which stand for static sources."""
    return live.static_cells(hotspots(spark, sf_dir))


def newest(arrived):
    """The newest day of all that has come, other records included."""
    return str(arrived.agg(F.max("date")).first()[0])


def week(spark, sf_dir):
    arrived = observations(spark, sf_dir).filter("date <= date'2001-03-15'")
    obs = live.window(arrived.filter("sensor = 'B'"), newest(arrived))
    g = grid(spark, sf_dir).filter("ci % 2 = 0 or ci % 9 = 0").drop("district", "people_cell")
    listed = live.listed_seasons(grid(spark, sf_dir).filter("ci % 9 = 0").select("ci", "cj", F.lit("inspect first").alias("priority"), F.lit(2001).alias("season")))
    return live.enrich(obs, still(spark, sf_dir), g, listed)


@BOOK.add("haversine", q(("pts",), f"SELECT pid, {r('2 * 6371.0e0 * asin(sqrt(sin(radians(22.0e0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(22.0e0)) * sin(radians(92.5e0 - lon) / 2) ** 2)) AS km')} FROM pts"))
def haversine(spark, sf_dir):
    return rounded(spots_of(spark, sf_dir).select("pid", spatial.haversine_km(F.col("lat"), F.col("lon"), F.lit(22.0), F.lit(92.5)).alias("km")))


def _nearest_sql(km: str, where: str = "") -> str:
    return f"SELECT pid, name AS place, {r('km')} FROM (SELECT pid, name, {km} AS km, row_number() OVER (PARTITION BY pid ORDER BY {km}, place_id) AS n FROM pts p CROSS JOIN places s {where}) WHERE n = 1"


@BOOK.add("nearest_place", q(("pts", "places"), _nearest_sql("2 * 6371.0e0 * asin(sqrt(sin(radians(s.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(s.lat)) * sin(radians(s.lon - p.lon) / 2) ** 2))")))
def nearest_place(spark, sf_dir):
    return rounded(spatial.nearest_place(spots_of(spark, sf_dir), places(spark), ["pid"]))


@BOOK.add("nearest_place_equirect", q(("pts", "places"), _nearest_sql("sqrt(((p.lat - s.lat) * 110.57e0) ** 2 + ((p.lon - s.lon) * 111.32e0 * cos(radians(22.5e0))) ** 2)", "WHERE name <> '(unnamed)'")))
def nearest_place_equirect(spark, sf_dir):
    return rounded(spatial.nearest_place(spots_of(spark, sf_dir), places(spark), ["pid"], spatial.flat_km, named_only=True))


PIP = """SELECT pid, poly_id FROM pts CROSS JOIN edges GROUP BY pid, poly_id
HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1
  OR bool_or(lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) AND abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) <= 1e-12)"""


@BOOK.add("pip_raycast", q(("pts", "edges"), f"SELECT pid, max(h.poly_id) AS poly_id FROM pts LEFT JOIN ({PIP}) h USING (pid) GROUP BY pid"))
def pip_raycast(spark, sf_dir):
    return spatial.tag_polygons(spots_of(spark, sf_dir), spatial.edges_of(polygons(spark)), ["pid"], 0.1)


@BOOK.add("admin_tag", q(("obs",), """
SELECT CASE WHEN lat BETWEEN 21.2e0 AND 21.3e0 AND lon BETWEEN 92.0e0 AND 92.4e0 THEN 1 WHEN lat BETWEEN 21.0e0 AND 21.2e0 AND lon BETWEEN 92.0e0 AND 92.2e0 THEN 0 END AS box, count(*) AS n FROM obs GROUP BY box"""))
def admin_tag(spark, sf_dir):
    box = lambda w, s, e, n: [[[w, s], [e, s], [e, n], [w, n], [w, s]]]
    areas = spark.createDataFrame([(0, box(92.0, 21.0, 92.2, 21.2)), (1, box(92.0, 21.2, 92.4, 21.3))], "poly_id int, rings array<array<array<double>>>")
    spots = observations(spark, sf_dir).groupBy("lat", "lon").agg(F.count("*").alias("n")).withColumn("pid", F.struct("lat", "lon"))
    tagged = spatial.tag_polygons(spots, spatial.edges_of(areas), ["pid"], 0.1)
    return spots.join(tagged, "pid").groupBy(F.col("poly_id").alias("box")).agg(F.sum("n").alias("n"))


@BOOK.add("static_dilate", q(("static",), "SELECT * FROM static"))
def static_dilate(spark, sf_dir):
    return static(spark, sf_dir)


@BOOK.add("static_members", q(("obs", "static"), "SELECT count(*) AS inside FROM obs WHERE EXISTS (SELECT 1 FROM static s WHERE s.fi = floor(lat / 0.01e0) AND s.fj = floor(lon / 0.01e0))"))
def static_members(spark, sf_dir):
    from quillspan.operators.grid import members

    return members(with_cells(observations(spark, sf_dir), 0.01, ("fi", "fj")), static(spark, sf_dir), ("fi", "fj")).agg(F.count("*").alias("inside"))


@BOOK.add("tile_decode", """
SELECT tile, (tile // 2) * 256 + i // 16 AS row, (tile % 2) * 256 + i % 16 AS col, r * 256.0e0 + g + b / 256.0e0 - 32768.0e0 AS value
FROM (SELECT event_id // 256 AS tile, event_id % 256 AS i, 128 + user_id % 3 AS r, event_id % 251 AS g, user_id * 7 % 256 AS b FROM events)""")
def tile_decode(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    tile = F.floor(i / 256).cast("long")
    px = table(spark, sf_dir, "events").select((F.floor(tile / 2) + 10).alias("ty"), (tile % 2 + 20).alias("tx"), F.floor(i % 256 / 16).cast("long").alias("r"), (i % 16).alias("c"), spatial.tile_elevation(128 + u % 3, i % 251, u * 7 % 256).alias("value"))
    key = (F.floor(F.col("row") / 256) * 2 + F.floor(F.col("col") / 256)).alias("tile")
    return spatial.mosaic(px, 20, 10).select(key, "row", "col", "value")


@BOOK.add("mercator", q(("pts",), f"SELECT pid, {r('(lon + 180) / 360 * 4096 AS tx', '(1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096 AS ty')} FROM pts"))
def mercator(spark, sf_dir):
    return rounded(spots_of(spark, sf_dir).select("pid", spatial.tile_x(F.col("lon"), 12).alias("tx"), spatial.tile_y(F.col("lat"), 12).alias("ty")))


@BOOK.add("pixel_centres", f"SELECT i AS k, {r('degrees(atan((exp(pi() * (1 - 2 * (1780 + (i + 0.5e0) / 256) / 4096)) - exp(-pi() * (1 - 2 * (1780 + (i + 0.5e0) / 256) / 4096))) / 2)) AS lat', '(3090 + (i + 0.5e0) / 256) / 4096 * 360 - 180 AS lon')} FROM (SELECT event_id AS i FROM events)")
def pixel_centres(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), spatial.pixel_lat(F.col("event_id"), 1780, 12).alias("lat"), spatial.pixel_lon(F.col("event_id"), 3090, 12).alias("lon")))


@BOOK.add("slope", q(("sloped",), f"SELECT row, col, {r('slope')} FROM sloped"))
def slope(spark, sf_dir):
    return rounded(sloped(spark, sf_dir).select("row", "col", "slope"))


@BOOK.add("zonal_stats", q(("sloped",), f"SELECT row // 8 AS ci, col // 8 AS cj, {r('avg(value) AS elev_mean', 'avg(slope) AS slope_mean', 'quantile_cont(slope, 0.9) AS slope_p90', 'avg(CASE WHEN slope >= 15 THEN 1.0e0 ELSE 0.0e0 END) AS steep_frac')} FROM sloped GROUP BY ALL"))
def zonal_stats(spark, sf_dir):
    cells = sloped(spark, sf_dir).withColumn("ci", F.floor(F.col("row") / 8).cast("long")).withColumn("cj", F.floor(F.col("col") / 8).cast("long"))
    return rounded(spatial.zonal_stats(cells))


@BOOK.add("footprint_slope", q(("sloped", "spots"), f"""
SELECT p.pid, {r('CASE WHEN count(s.slope) = 25 THEN avg(s.slope) END AS mean_slope', 'CASE WHEN count(s.slope) = 25 THEN avg(CASE WHEN s.slope >= 15 THEN 1.0e0 ELSE 0.0e0 END) END AS steep_share')}
FROM spots p LEFT JOIN sloped s ON abs(s.row - p.row) <= 2 AND abs(s.col - p.col) <= 2 GROUP BY p.pid"""))
def footprint_slope(spark, sf_dir):
    return rounded(spatial.footprint_slope(spots(spark, sf_dir), sloped(spark, sf_dir), ["pid"], 2))


@BOOK.add("box_population", q(("raster", "spots"), f"SELECT p.pid, {r('coalesce(sum(greatest(s.value - 8, 0)), 0) AS people')} FROM spots p LEFT JOIN raster s ON abs(s.row - p.row) <= 1 AND abs(s.col - p.col) <= 1 GROUP BY p.pid"))
def box_population(spark, sf_dir):
    return rounded(spatial.box_population(spots(spark, sf_dir), raster(spark, sf_dir).withColumn("value", F.col("value") - 8), ["pid"], 1))


@BOOK.add("cell_population", q(("raster", "grid"), f"SELECT g.ci, g.cj, {r('coalesce(p, 0) AS population')} FROM grid g LEFT JOIN (SELECT 1050 + row // 4 AS ci, 4600 + col // 4 AS cj, sum(greatest(value, 0)) AS p FROM raster GROUP BY ALL) x USING (ci, cj)"))
def cell_population(spark, sf_dir):
    pixels = raster(spark, sf_dir).select((1050 + F.floor(F.col("row") / 4)).alias("ci"), (4600 + F.floor(F.col("col") / 4)).alias("cj"), "value")
    return rounded(spatial.cell_population(pixels, grid(spark, sf_dir).select("ci", "cj")))


# Positions in zone 46, whose middle is 93 degrees east; n is the third flattening of WGS 84.
part("consts", (), "SELECT n, 2 * sqrt(n) / (1 + n) AS e, 6378137e0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.9996e0 AS m, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] AS a FROM (SELECT (1 / 298.257223563e0) / (2 - 1 / 298.257223563e0) AS n)")
part("angles", ("pts", "consts"), """
SELECT pid, m, a, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta
FROM (SELECT *, radians(lon - 93) AS w, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM pts, consts)""")
part("utm", ("angles",), """
SELECT pid, 500000 + m * (eta + list_sum(list_transform(range(1, 5), lambda k: a[k] * cos(2 * k * xi) * sinh(2 * k * eta)))) AS east,
  m * (xi + list_sum(list_transform(range(1, 5), lambda k: a[k] * sin(2 * k * xi) * cosh(2 * k * eta)))) AS north FROM angles""")


@BOOK.add("utm", q(("utm",), "SELECT pid, round(east, 4) AS east, round(north, 4) AS north FROM utm"))
def utm(spark, sf_dir):
    p = spots_of(spark, sf_dir)
    east, north = projection.to_utm(F.col("lat"), F.col("lon"), projection.epsg_of(F.col("lat"), F.col("lon")))
    return p.select("pid", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


@BOOK.add("snap_grid", q(("utm",), "SELECT pid, floor(east / 40) * 40 AS x0, ceil(east / 40) * 40 AS x1, floor(north / 40) * 40 AS y0, ceil(north / 40) * 40 AS y1 FROM utm"))
def snap_grid(spark, sf_dir):
    p = spots_of(spark, sf_dir)
    east, north = projection.to_utm(F.col("lat"), F.col("lon"), F.lit(32646))
    sides = zip(("x0", "x1", "y0", "y1"), (*spatial.snap(east, east), *spatial.snap(north, north)), strict=True)
    return p.select("pid", *(c.cast("double").alias(n) for n, c in sides))


@BOOK.add("reflectance", f"SELECT id, {r('CASE WHEN k = 0 THEN CAST(dn AS DOUBLE) WHEN dn = 0 THEN NULL WHEN k = 1 THEN dn * 0.0001e0 - 0.1e0 ELSE dn * 0.0001e0 END AS value')} FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 2750 AS dn, l_linenumber % 3 AS k FROM lineitem)")
def reflectance(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 2750).alias("dn"), (F.col("l_linenumber") % 3).alias("k"))
    scale = F.when(F.col("k") > 0, 0.0001)
    return rounded(base.select("id", imagery.reflectance(F.col("dn"), scale, F.lit(-0.1), F.col("k") == 2).alias("value")))


@BOOK.add("scene_search", q(("scenes",), "SELECT cell, win AS window, scene FROM (SELECT DISTINCT cell, win, scene, (cell * 31 + scene * 17) % 100 AS cloud FROM scenes) WHERE cloud < 70 QUALIFY row_number() OVER (PARTITION BY cell, win ORDER BY cloud, scene) <= 3"))
def scene_search(spark, sf_dir):
    s = scenes(spark, sf_dir).select("cell", "window", "scene", ((F.col("cell") * 31 + F.col("scene") * 17) % 100).alias("cloud")).distinct()
    return imagery.search_scenes(s, 70, 3).select("cell", "window", "scene")


@BOOK.add("nbr_composite", q(("nbr",), f"SELECT cell, win AS window, row, col, {r('nbr')} FROM nbr"))
def nbr_composite(spark, sf_dir):
    return rounded(composites(spark, sf_dir))


@BOOK.add("dnbr_cell", q(("dnbr",), f"SELECT cell, {r('clear_share', 's10 AS scar_share_10', 's20 AS scar_share_20', 's27 AS scar_share_27', 's44 AS scar_share_44', 's27 AS scar_share', 'dm AS dnbr_median')}, verdict FROM dnbr"))
def dnbr_cell(spark, sf_dir):
    return rounded(checked(spark, sf_dir))


@BOOK.add("threshold_matrix", q(("dnbr",), "SELECT CASE WHEN cell % 2 = 0 THEN 'priority' ELSE 'control' END AS \"group\", t AS threshold, CAST(sh AS DOUBLE) AS share, count(*) FILTER (CASE t WHEN 10 THEN s10 WHEN 20 THEN s20 WHEN 27 THEN s27 ELSE s44 END >= sh) AS cells FROM dnbr CROSS JOIN (VALUES (10), (20), (27), (44)) a(t) CROSS JOIN (VALUES (0.02e0), (0.05e0), (0.10e0)) b(sh) WHERE verdict <> 'no clear imagery' GROUP BY ALL"))
def threshold_matrix(spark, sf_dir):
    return imagery.threshold_matrix(checked(spark, sf_dir).withColumn("group", F.when(F.col("cell") % 2 == 0, "priority").otherwise("control")))


@BOOK.add("group_summary", q(("dnbr",), f"SELECT CASE WHEN cell % 2 = 0 THEN 'priority' ELSE 'control' END AS \"group\", count(*) AS cells, count(*) FILTER (verdict <> 'no clear imagery') AS with_imagery, count(*) FILTER (verdict = 'scar visible') AS visible, {r(*(f"median(CASE WHEN verdict <> 'no clear imagery' THEN {c} END) AS {n}" for c, n in (('s27', 'scar_share_median'), ('clear_share', 'clear_share_median'))))} FROM dnbr GROUP BY ALL"))
def group_summary(spark, sf_dir):
    return rounded(imagery.group_summary(checked(spark, sf_dir).withColumn("group", F.when(F.col("cell") % 2 == 0, "priority").otherwise("control"))))


@BOOK.add("mann_whitney_u", """
SELECT count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g <> 'A') AS n2, sum(rk) FILTER (g = 'A') AS rank_sum, sum(rk) FILTER (g = 'A') - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2 AS u
FROM (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS rk FROM lineitem WHERE l_returnflag IN ('A', 'R'))""")
def mann_whitney_u(spark, sf_dir):
    return stats.mann_whitney(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R")


@BOOK.add("live_counts", q(("week",), "SELECT count(*) AS fires, count(*) FILTER (hills) AS hills, count(*) FILTER (chk) AS \"check\" FROM week"))
def live_counts(spark, sf_dir):
    return live.counts(week(spark, sf_dir))


@BOOK.add("live_fires", q(("week",), "SELECT round_even(lat, 4) AS lat, round_even(lon, 4) AS lon, date, hhmm, round_even(frp, 1) AS frp, CASE WHEN chk THEN 2 WHEN hills THEN 1 ELSE 0 END AS level FROM week"))
def live_fires(spark, sf_dir):
    return live.compact(week(spark, sf_dir))


@BOOK.add("live_alerts", q(("week",), "SELECT ci, cj, count(*) AS fires, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, max(slope_mean) AS slope_mean, max(population) AS population, bool_or(seasons IS NOT NULL) AS listed, bool_or(chk) AS \"check\" FROM week WHERE hills GROUP BY ci, cj"))
def live_alerts(spark, sf_dir):
    a = live.alerts(week(spark, sf_dir))
    return a.select("ci", "cj", "fires", F.col("first.date").cast("string").alias("first_day"), F.col("last.date").cast("string").alias("last_day"), "slope_mean", "population", F.col("seasons").isNotNull().alias("listed"), "check")


@BOOK.add("normal_week", q(("obs",), f"SELECT {r('avg(n) AS normal')} FROM (SELECT y, count(id) AS n FROM range(1994, 2002) v(y) LEFT JOIN obs ON date > make_date(y, 3, 8) AND date <= make_date(y, 3, 15) GROUP BY y)"))
def normal_week(spark, sf_dir):
    return rounded(live.normal_week(observations(spark, sf_dir), "2001-03-15", list(range(1994, 2002))))


@BOOK.add("same_day", """
SELECT d AS day, y AS year, make_date(y, month(d), CASE WHEN month(d) = 2 AND day(d) = 29 AND y % 4 <> 0 THEN 28 ELSE day(d) END) AS then
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) CROSS JOIN (SELECT CAST(v AS INT) AS y FROM range(2001, 2010) t(v))""")
def same_day(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumn("year", F.explode(F.array(*map(F.lit, range(2001, 2010))))).withColumn("then", live.same_day(F.col("day"), F.col("year")))


@BOOK.add("listed_seasons", q(("grid",), "SELECT ci, cj, ['2001', '2002'] AS seasons FROM grid WHERE ci % 9 = 0"))
def listed_seasons(spark, sf_dir):
    lists = grid(spark, sf_dir).withColumn("season", F.explode(F.array(F.lit(2002), F.lit(2001)))).withColumn("priority", F.when(F.col("ci") % 9 == 0, "inspect first").otherwise("monitor"))
    return live.listed_seasons(lists)


@BOOK.add("map_json", q(("grid",), "SELECT '{\"ci\":' || ci || ',\"cj\":' || cj || ',\"none\":null}' AS json FROM grid"))
def map_json(spark, sf_dir):
    from quillspan.sources.writers import as_json

    return as_json(grid(spark, sf_dir).select("ci", "cj", F.lit(None).cast("int").alias("none")))


@BOOK.add("streaming_daily", """
WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS t, 1050 + CAST(user_id % 20 AS BIGINT) AS ci, 4600 + CAST(user_id % 10 AS BIGINT) AS cj FROM events)
SELECT date_trunc('day', t)::TIMESTAMP AS day, ci, cj, count(DISTINCT event_id) AS fires FROM e
WHERE date_trunc('day', t) + INTERVAL 1 DAY <= (SELECT max(t) FROM e) - INTERVAL 2 DAY GROUP BY ALL""")
def streaming_daily(spark, sf_dir):
    """Counts per day and cell of the events table read as a stream, worked off at once; days that may still get late events wait."""
    from quillspan.staging import scratch_folder
    from quillspan.streaming import watch

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema.simpleString()[7:-1].replace(":", " ")
    run = scratch_folder(spark, "watch")
    events = watch.arrivals(spark, f"{sf_dir}/events.parquet*", schema)
    placed = events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(21.0005) + (F.col("user_id") % 20) * 0.02).alias("lat"), (F.lit(92.0005) + (F.col("user_id") % 10) * 0.02).alias("lon"))
    watch.run_available(watch.daily_cells(placed), lambda batch, n: batch.write.mode("overwrite").parquet(f"{run}/out/batch={n}"), f"{run}/state")
    return spark.read.parquet(f"{run}/out").select(F.col("window.start").alias("day"), "ci", "cj", "fires")


part("came", ("obs", "newest"), "SELECT *, CAST(floor(lat / 0.02e0) AS BIGINT) AS i, CAST(floor(lon / 0.02e0) AS BIGINT) AS j FROM obs, newest WHERE date > newest - 14 AND date <= newest")
part("marked", ("came", "still", "grid"), """
SELECT c.*, CASE WHEN sensor <> 'B' THEN 'outside' WHEN EXISTS (SELECT 1 FROM still s WHERE s.fi = floor(c.lat / 0.01e0) AND s.fj = floor(c.lon / 0.01e0)) THEN 'static' ELSE 'fire' END AS scope,
  g.ci IS NOT NULL AS hills, g.ci IS NOT NULL AND (g.slope_mean >= 15 AND g.population >= 200 OR g.ci % 9 = 0) AS chk
FROM came c LEFT JOIN (SELECT * FROM grid WHERE ci % 2 = 0 OR ci % 9 = 0) g ON g.ci = c.i AND g.cj = c.j""")


@BOOK.add("live_watch", q(("marked",), """
SELECT date AS day, scope, CASE WHEN scope = 'outside' THEN 0 ELSE i END AS ci, CASE WHEN scope = 'outside' THEN 0 ELSE j END AS cj, CASE WHEN scope = 'outside' THEN 0 ELSE count(DISTINCT id) END AS fires,
  CASE WHEN scope <> 'outside' THEN min(lpad(CAST(hhmm AS VARCHAR), 4, '0')) END AS first, CASE WHEN scope <> 'outside' THEN max(lpad(CAST(hhmm AS VARCHAR), 4, '0')) END AS last,
  scope <> 'outside' AND bool_or(hills) AS hills, scope <> 'outside' AND bool_or(chk) AS "check"
FROM marked GROUP BY 1, 2, 3, 4"""))
def live_watch(spark, sf_dir):
    """The stateful watch over line items that arrive as a stream of files, those of the last fortnight; record A stands for what lies outside the region."""
    from quillspan.staging import scratch_folder
    from quillspan.streaming import watch

    lines = table(spark, sf_dir, "lineitem")
    end = newest(observations(spark, sf_dir).filter("date <= date'2001-03-15'"))
    arriving = watch.arrivals(spark, f"{sf_dir}/lineitem.parquet*", lines.schema).filter(F.to_date("l_shipdate").between(F.date_sub(F.to_date(F.lit(end)), 13), F.to_date(F.lit(end))))
    obs = observations(spark, sf_dir, arriving).withColumn("hhmm", F.lpad(F.col("hhmm").cast("string"), 4, "0"))
    stream = obs.select("id", F.to_timestamp("date").alias("ts"), "date", "hhmm", "lat", "lon", "frp", (F.col("sensor") == "B").alias("inside"))
    g = grid(spark, sf_dir).filter("ci % 2 = 0 or ci % 9 = 0")
    listed = live.listed_seasons(grid(spark, sf_dir).filter("ci % 9 = 0").select("ci", "cj", F.lit("inspect first").alias("priority"), F.lit(2001).alias("season")))
    run = scratch_folder(spark, "watch")
    watch.run_available(watch.cell_days(stream, still(spark, sf_dir), g, listed), lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{run}/out/{n}"), f"{run}/state", "update")
    key = ["day", "scope", "ci", "cj"]
    cells = spark.read.parquet(f"{run}/out/*").filter("kind = 'cell'").groupBy(*key).agg(F.max_by(F.struct("fires", "first", "last", "hills", "check"), "batch").alias("now"))
    return cells.select(*key, "now.*")


@BOOK.add("read_window", q(("raster",), f"""
SELECT y AS row, x AS col, coalesce(value, 0) AS value FROM range(8) a(y) CROSS JOIN range(9) b(x) LEFT JOIN raster ON row = y + {SIZE - 5} AND col = x - 3"""))
def read_window(spark, sf_dir):
    return spatial.read_window(raster(spark, sf_dir), SIZE - 5, -3, 8, 9)


@BOOK.add("live_static", q(("obs", "still", "newest"), "SELECT count(*) AS static FROM obs o WHERE date > (SELECT newest - 7 FROM newest) AND date <= (SELECT newest FROM newest) AND sensor = 'B' AND EXISTS (SELECT 1 FROM still s WHERE s.fi = floor(o.lat / 0.01e0) AND s.fj = floor(o.lon / 0.01e0))"))
def live_static(spark, sf_dir):
    arrived = observations(spark, sf_dir).filter("date <= date'2001-03-15'")
    recent = live.window(arrived.filter("sensor = 'B'"), newest(arrived))
    return live.static_count(recent, still(spark, sf_dir))


@BOOK.add("normal_hills_week", q(("obs", "hotspots", "grid"), f"""
SELECT {r('avg(n) AS normal')} FROM (SELECT y, count(id) AS n FROM range(1995, 2002) v(y) LEFT JOIN (SELECT o.* FROM obs o JOIN grid g ON floor(o.lat / 0.02e0) = g.ci AND floor(o.lon / 0.02e0) = g.cj
  WHERE g.ci % 2 = 0 AND NOT EXISTS (SELECT 1 FROM hotspots s WHERE abs(s.fi - floor(o.lat / 0.01e0)) <= 1 AND abs(s.fj - floor(o.lon / 0.01e0)) <= 1)) p ON date > make_date(y, 3, 8) AND date <= make_date(y, 3, 15) GROUP BY y)"""))
def normal_hills_week(spark, sf_dir):
    """Detections in half of the grid and off static sources."""
    obs = observations(spark, sf_dir)
    return rounded(live.normal_hills_week(obs, grid(spark, sf_dir).filter("ci % 2 = 0"), still(spark, sf_dir), "2001-03-15", list(range(1995, 2002))))


def hotspots(spark, sf_dir):
    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < -500").select((F.lit(92.0005) + (F.col("s_suppkey") % 20) * F.lit(0.02)).alias("lon"), (F.lit(21.0005) + (F.col("s_suppkey") % 200) * F.lit(0.002)).alias("lat"))
    return poor.withColumn("kind", F.lit(2))
