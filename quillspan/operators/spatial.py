"""Distances, polygons, map tiles and rasters held as long tables (row, col, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.staging import written

EARTH_KM = 6371.0
TILE = 256


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at_lat: float = 22.5) -> Column:
    """Distance on a plane that fits around one latitude."""
    kx = 111.32 * math.cos(math.radians(at_lat))
    return F.hypot((lat1 - lat2) * 110.57, (lon1 - lon2) * kx)


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    return [EARTH_KM * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), EARTH_KM * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), EARTH_KM * F.sin(F.radians(lat))]


def _on_plane(lat: Column, lon: Column) -> list[Column]:
    return [lon * (111.32 * math.cos(math.radians(22.5))), lat * 110.57, F.lit(0.0)]


#: For each distance: positions in space, whose straight distances are in the same order, and half the width of a cube that holds them.
SPACES = {haversine_km: (_on_sphere, 6400.0), flat_km: (_on_plane, 20000.0)}
#: Levels of cubes, of 2^level to a side, from the 64 that every point looks at; those of the last are at most 3 km wide.
LEVELS = range(2, 15, 2)
#: Places that a cube may hold without being split.
CUBE_PLACES = 16
#: Kilometres by which bounds may be off, as they are reckoned otherwise than distances.
SLACK_KM = 1e-5


def _cubes(at: Column, half: float, level: int) -> Column:
    """The cube that holds a position, by three numbers."""
    side = 2 * half / 2**level
    return F.transform(at, lambda x: F.floor((x + half) / side).cast("int"))


def _far(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _least_km(at: Column, cube: Column, half: float, side: Column) -> Column:
    """From a position to the nearest point of a cube."""
    return _far(at, F.zip_with(at, cube, lambda x, i: F.greatest(i * side - half, F.least((i + 1) * side - half, x))))


def nearest_place(points: DataFrame, places: DataFrame, keys: list[str], distance=haversine_km, named_only: bool = False) -> DataFrame:
    """keys, place and km: the nearest place of each point; the place with the smaller place_id wins a tie.

    points: keys, lat, lon, one row for each set of keys. places: place_id,
    name, lat, lon. Places lie in cubes in space, so that neither the poles nor
    the date line are special; a cube of more than CUBE_PLACES is split. A point
    goes down the cubes: those stay whose nearest corner is not farther away
    than some place of another one, until only cubes that aren't split are
    left, whose places it meets. Cubes of the first level, 64 at most, go to
    the points; of the others a point sees the parts of cubes that it still
    holds. Without places nothing comes out.
    """
    locate, half = SPACES[distance]
    if named_only:
        places = places.filter("name != '(unnamed)'")
    # Of places at one spot the first is the nearest of them to anyone.
    spots = places.groupBy(F.col("lat").alias("_plat"), F.col("lon").alias("_plon")).agg(F.min("place_id").alias("place_id"), F.min_by("name", "place_id").alias("name"))
    spots = spots.withColumn("_at", F.array(*locate(F.col("_plat"), F.col("_plon"))))
    side = lambda level: 2 * half / 2**level
    tables, held = {}, spots.withColumn("_up", F.lit(None).cast("array<int>"))
    for level in LEVELS:
        held = held.withColumn("_cube", _cubes(F.col("_at"), half, level))
        cubes = held.groupBy("_cube").agg(F.count("*").alias("_n"), F.min_by("_at", "place_id").alias("_some"), F.first("_up").alias("_up"))
        cubes = cubes.withColumn("_leaf", (F.col("_n") <= CUBE_PLACES) | F.lit(level == LEVELS[-1])).drop("_n")
        tables[level] = written(cubes, f"cubes{level}")
        split = tables[level].filter("not _leaf").select("_cube")
        if not split.count():
            break
        held = held.join(split, "_cube").withColumn("_up", F.col("_cube"))
    at = F.array(*locate(F.col("lat"), F.col("lon")))
    # The rows of a point: cubes with their level, the least distance to them, and that to one of their places.
    seen = lambda level, bound: F.struct(F.lit(level).alias("level"), bound["_cube"].alias("cube"), bound["_leaf"].alias("leaf"), _least_km(F.col("_at"), bound["_cube"], half, F.lit(side(level))).alias("low"), _far(F.col("_at"), bound["_some"]).alias("high"))
    bounded = lambda rows: F.filter(rows, lambda c: c.low <= F.array_min(F.transform(rows, lambda d: d.high)) + SLACK_KM)
    first = tables[LEVELS[0]].agg(F.collect_list(F.struct("_cube", "_leaf", "_some")).alias("_first"))  # 64 cubes at most
    rows = points.select(*keys, "lat", "lon", at.alias("_at")).crossJoin(F.broadcast(first))
    rows = rows.withColumn("_all", F.transform("_first", lambda c: seen(LEVELS[0], c))).withColumn("_left", bounded(F.col("_all"))).drop("_first", "_all")
    for level in list(tables)[1:]:
        one = rows.withColumn("_c", F.explode("_left")).drop("_left")
        parts = tables[level].select(F.col("_up"), F.struct("_cube", "_leaf", "_some").alias("_part"))
        met = one.filter("not _c.leaf").join(parts, F.col("_c.cube") == F.col("_up")).select(*keys, "lat", "lon", "_at", seen(level, F.col("_part")).alias("_c"))
        both = met.unionByName(one.filter("_c.leaf").select(*met.columns)).groupBy(*keys).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("_at").alias("_at"), F.collect_list("_c").alias("_all"))
        # A point holds few cubes at a time: those that a shell of one cube's width around its bound cuts.
        rows = written(both.withColumn("_left", bounded(F.col("_all"))).drop("_all"), f"rows{level}")
    homes = None
    for level, cubes in tables.items():
        inside = spots.withColumn("_cube", _cubes(F.col("_at"), half, level)).join(cubes.filter("_leaf").select("_cube"), "_cube")
        part = inside.select(F.lit(level).alias("_level"), "_cube", "place_id", "name", "_plat", "_plon")
        homes = part if homes is None else homes.unionByName(part)
    km = distance(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"))
    leaves = rows.withColumn("_c", F.explode("_left")).select(*keys, "lat", "lon", F.col("_c.level").alias("_level"), F.col("_c.cube").alias("_cube"))
    best = leaves.join(homes, ["_level", "_cube"]).groupBy(*keys).agg(F.min_by(F.struct("name", km.alias("km")), F.struct(km, "place_id")).alias("b"))
    return best.select(*keys, F.col("b.name").alias("place"), F.col("b.km").alias("km"))


def edges_of(polygons: DataFrame) -> DataFrame:
    """Edges (poly_id, ring, x1, y1, x2, y2) of polygons (poly_id, rings: array of arrays of (x, y))."""
    rings = polygons.select("poly_id", F.posexplode("rings").alias("ring", "pts"))
    pairs = F.zip_with(F.slice("pts", F.lit(1), F.size("pts") - 1), F.slice("pts", F.lit(2), F.size("pts") - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return rings.select("poly_id", "ring", F.explode(pairs).alias("e")).select("poly_id", "ring", "e.*")


def _left_of(x: Column, y: Column) -> Column:
    """Whether (x, y) lies to the left of the edge (x1, y1, x2, y2). On its line, the point moved up a little, and to the right by far less, decides."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = dx * (y - F.col("y1")) - dy * (x - F.col("x1"))
    return F.when(s != 0, s > 0).when(dx != 0, dx > 0).otherwise(dy < 0)


def polygon_cells(edges: DataFrame, step: float) -> tuple[DataFrame, DataFrame]:
    """Polygons cut along a grid: cells (poly_id, gx, gy, inside) that a polygon covers or its outline touches, and the edges (poly_id, gx, gy, x1, y1, x2, y2) that touch each.

    inside says whether the middle of the cell is in the polygon. A row of
    cells is crossed by a line through its middles; from the outline's
    crossings with it, in order, the middles between the first and the second,
    the third and the fourth and so on are inside.
    """
    slack = step * 1e-9
    number = lambda v: F.floor(v / step).cast("long")
    middle = lambda g: (g + 0.5) * step
    edges = edges.select("poly_id", "x1", "y1", "x2", "y2").filter("x1 != x2 or y1 != y2")
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = edges.withColumn("gx", F.explode(F.sequence(number(low - slack), number(high + slack))))
    # Where the edge is within a column of cells.
    height = lambda x: F.when(F.col("x1") == F.col("x2"), F.col("y1")).otherwise(F.col("y1") + (F.greatest(low, F.least(high, x)) - F.col("x1")) * F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    y_a, y_b = height(F.col("gx") * step - slack), F.when(F.col("x1") == F.col("x2"), F.col("y2")).otherwise(height((F.col("gx") + 1) * step + slack))
    own = columns.withColumn("gy", F.explode(F.sequence(number(F.least(y_a, y_b) - slack), number(F.greatest(y_a, y_b) + slack))))
    rows = edges.withColumn("gy", F.explode(F.sequence(number(F.least("y1", "y2")) - 1, number(F.greatest("y1", "y2")) + 1)))
    y = middle(F.col("gy"))
    rows = rows.filter((F.col("y1") > y) != (F.col("y2") > y))
    guess = number(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) - step / 2)
    right = lambda g: (_left_of(middle(g), y) == (F.col("y2") > F.col("y1"))).cast("long")  # noqa: E731  the crossing is right of the middle
    crossed = rows.withColumn("_g", guess).select("poly_id", "gy", (F.col("_g") - 1 + right(F.col("_g") - 1) + right(F.col("_g")) + right(F.col("_g") + 1)).alias("from"))
    order = Window.partitionBy("poly_id", "gy").orderBy("from")
    spans = crossed.select("poly_id", "gy", "from", F.lead("from").over(order).alias("to"), F.row_number().over(order).alias("n")).filter("n % 2 = 1 and `from` < `to`")
    within = spans.select("poly_id", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("gx"), "gy", F.lit(True).alias("inside"))
    cells = within.unionByName(own.select("poly_id", "gx", "gy", F.lit(False).alias("inside"))).groupBy("poly_id", "gx", "gy").agg(F.bool_or("inside").alias("inside"))
    return cells, own


def tag_polygons(points: DataFrame, edges: DataFrame, keys: list[str], step: float = 1.0) -> DataFrame:
    """keys and poly_id of the polygon around each point; the largest poly_id of several, null outside all.

    Points meet the cells of polygon_cells(), and in cells that an outline
    touches the edges there, no others: a point is on the same side as its
    cell's middle if the way there, first along the row, then up or down,
    crosses an even number of them. A point on an edge (to 1e-12 square units)
    is inside. step: width of a cell, small enough for few edges to share one.
    """
    cells, own = polygon_cells(edges, step)
    near = points.select(*keys, "lat", "lon", F.floor(F.col("lon") / step).cast("long").alias("gx"), F.floor(F.col("lat") / step).cast("long").alias("gy"))
    met = near.join(cells, ["gx", "gy"]).join(own, ["poly_id", "gx", "gy"], "left")
    x, y, mx, my = F.col("lon"), F.col("lat"), (F.col("gx") + 0.5) * step, (F.col("gy") + 0.5) * step
    along = ((F.col("y1") > my) != (F.col("y2") > my)) & (_left_of(mx, my) != _left_of(x, my))
    up = ((F.col("x1") > x) != (F.col("x2") > x)) & (_left_of(x, my) != _left_of(x, y))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    beside = x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    on_edge = beside & (F.abs(dx * (y - F.col("y1")) - dy * (x - F.col("x1"))) <= 1e-12)
    turned = F.count_if(along != up) % 2 == 1  # nothing to count where no edge is
    hit = met.groupBy(*keys, "poly_id").agg((F.bool_or("inside") != turned).alias("in"), F.bool_or(on_edge).alias("edge")).filter("in or edge").groupBy(*keys).agg(F.max("poly_id").alias("poly_id"))
    return points.select(*keys).join(hit, keys, "left")


def tile_x(lon: Column, zoom: int) -> Column:
    return (lon + 180) / 360 * 2**zoom


def tile_y(lat: Column, zoom: int) -> Column:
    return (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * 2**zoom


def pixel_lat(row: Column, y0: int, zoom: int) -> Column:
    """Latitude of the middle of a pixel row, counted from tile row y0."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * (y0 + (row + 0.5) / TILE) / 2**zoom))))


def pixel_lon(col: Column, x0: int, zoom: int) -> Column:
    return (x0 + (col + 0.5) / TILE) / 2**zoom * 360 - 180


def pixel_metres(lat: Column, zoom: int) -> Column:
    """Width of a map pixel at a latitude; 156543.03392 m is that of zoom 0 on the equator."""
    return F.cos(F.radians(lat)) * (156543.03392 / 2**zoom)


def footprint_radius(points: DataFrame, zoom: int, metres: float) -> int:
    """Pixels to each side that a footprint of so many metres covers at the mean latitude of the points (lat); 1 at least, also for no points."""
    mean = points.agg(F.avg("lat").alias("lat")).select(F.bround(metres / pixel_metres(F.col("lat"), zoom) / 2).alias("h")).first().h
    return max(1, int(mean or 0))


def tile_elevation(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def mosaic(tiles: DataFrame, x0: int, y0: int) -> DataFrame:
    """Pixels (tx, ty, r, c, value) of tiles as one raster (row, col, value)."""
    return tiles.select(((F.col("ty") - y0) * TILE + F.col("r")).alias("row"), ((F.col("tx") - x0) * TILE + F.col("c")).alias("col"), "value")


def decode_png_tiles(files: DataFrame) -> DataFrame:
    """Pixels (path, r, c, red, green, blue) of PNG tiles read as binary files."""
    from quillspan.sources.png import pixels

    return files.select("path", "content").mapInArrow(pixels, "path string, r int, c int, red int, green int, blue int")


def _gradient(value: str, along: Window) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(value).over(along), F.lead(value).over(along)
    return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def slope(raster: DataFrame, pixel_m: Column) -> DataFrame:
    """raster (row, col, value) with slope in degrees; pixel_m is a pixel's width, an expression of row."""
    down, right = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")
    g = raster.withColumn("_dy", _gradient("value", down)).withColumn("_dx", _gradient("value", right))
    return g.withColumn("slope", F.degrees(F.atan(F.hypot(F.col("_dx") / pixel_m, F.col("_dy") / pixel_m)))).drop("_dx", "_dy")


def zonal_stats(raster: DataFrame, steep: float = 15.0) -> DataFrame:
    """Per cell (ci, cj): mean value, mean and 90th percentile of slope, steep share."""
    return raster.groupBy("ci", "cj").agg(F.avg("value").alias("elev_mean"), F.avg("slope").alias("slope_mean"), F.percentile("slope", F.lit(0.9)).alias("slope_p90"), F.avg((F.col("slope") >= steep).cast("double")).alias("steep_frac"))


def footprint_slope(points: DataFrame, raster: DataFrame, keys: list[str], radius: int, steep: float = 15.0) -> DataFrame:
    """Mean slope and steep share in the window around each point (row, col); null where it leaves the raster.

    Sums slide along rows and then along columns, so that a point meets one
    pixel, however wide its window is. A window that misses any pixel misses it
    in the count as well, and is null.
    """
    size = (2 * radius + 1) ** 2
    along = lambda a, b: Window.partitionBy(a).orderBy(b).rangeBetween(-radius, radius)
    values = raster.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("slope").isNotNull().cast("int").alias("n"), F.col("slope").alias("s"), (F.col("slope") >= steep).cast("double").alias("t"))
    for a, b in (("row", "col"), ("col", "row")):
        values = values.select("row", "col", *(F.sum(c).over(along(a, b)).alias(c) for c in ("n", "s", "t")))
    stats = values.filter(F.col("n") == size).select("row", "col", (F.col("s") / size).alias("mean_slope"), (F.col("t") / size).alias("steep_share"))
    return points.select(*keys, "row", "col").join(stats, ["row", "col"], "left").drop("row", "col")


def summed_area(raster: DataFrame, value: Column) -> DataFrame:
    """row, col and total, the sum of value over all pixels up to that row and column, for every pixel of the box around the raster; pixels that are missing count 0.

    Two running sums, along rows, then down columns: a task holds a row or a
    column at a time.
    """
    given = raster.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value.cast("double").alias("v"))
    box = given.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("row", "col"))).filter("min_row is not null")
    rows = box.select(F.explode(F.sequence("min_row", "max_row")).alias("row"), "min_col", "max_col")
    spine = rows.select("row", F.explode(F.sequence("min_col", "max_col")).alias("col"), F.lit(0.0).alias("v"))
    dense = given.unionByName(spine).groupBy("row", "col").agg(F.sum("v").alias("v"))
    for a, b in (("row", "col"), ("col", "row")):
        dense = dense.withColumn("v", F.sum("v").over(Window.partitionBy(a).orderBy(b)))
    return dense.withColumnRenamed("v", "total")


def box_population(points: DataFrame, raster: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """People in the window around each point; pixels off the raster and negative ones hold none. Four lookups a point in a table of sums, however wide the window."""
    people = summed_area(raster, F.greatest("value", F.lit(0.0)))
    ends = raster.agg(F.max("row").cast("long").alias("_rows"), F.max("col").cast("long").alias("_cols"))
    corners = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(sign).alias("sign")) for r, c, sign in ((radius, radius, 1), (-radius - 1, radius, -1), (radius, -radius - 1, -1), (-radius - 1, -radius - 1, 1)))))
    at = points.select(*keys, "row", "col", corners.alias("_o")).crossJoin(F.broadcast(ends))  # one row
    at = at.select(*keys, F.least(F.col("row") + F.col("_o.r"), "_rows").alias("row"), F.least(F.col("col") + F.col("_o.c"), "_cols").alias("col"), "_o.sign")
    sums = at.join(people, ["row", "col"]).groupBy(*keys).agg(F.sum(F.col("sign") * F.col("total")).alias("people"))
    return points.select(*keys).join(sums, keys, "left").withColumn("people", F.coalesce("people", F.lit(0.0)))


def cell_population(raster: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with population, the sum of pixels (ci, cj, value); cells without pixels have 0."""
    sums = raster.groupBy("ci", "cj").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("population"))
    return grid.join(sums, ["ci", "cj"], "left").withColumn("population", F.coalesce("population", F.lit(0.0)))


def snap(lo: Column, hi: Column, step: float = 40.0) -> tuple[Column, Column]:
    """A projected interval widened to multiples of step."""
    return F.floor(lo / step) * step, F.ceil(hi / step) * step


def read_window(raster: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """Pixels (row, col, value) of a window, counted from its corner; those off the raster or without a value are 0."""
    spark = raster.sparkSession
    spine = spark.range(height * width).select(F.floor(F.col("id") / width).cast("long").alias("row"), (F.col("id") % width).alias("col"))
    inside = raster.filter(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
    inside = inside.select((F.col("row") - row0).cast("long").alias("row"), (F.col("col") - col0).cast("long").alias("col"), "value")
    return spine.join(inside, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast(raster.schema["value"].dataType)))


def tile_pixel(points: DataFrame, zoom: int, x0: int, y0: int) -> DataFrame:
    """points (lat, lon) with row and col of the pixel of a mosaic that begins at tile (x0, y0)."""
    return points.withColumn("row", F.floor((tile_y(F.col("lat"), zoom) - y0) * TILE).cast("long")).withColumn("col", F.floor((tile_x(F.col("lon"), zoom) - x0) * TILE).cast("long"))
