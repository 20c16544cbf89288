"""Polygons, nearest places, window sums, projection and images against brute force."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import imagery, projection, spatial
from quillspan.sources import png

RINGS = "poly_id int, rings array<array<array<double>>>"


def star(rng, x, y, r, n):
    """A ring with spikes; every fourth corner lies on the grid, to meet borders of cells."""
    pts = []
    for k in range(n):
        a, d = 2 * math.pi * k / n, r * rng.uniform(0.3, 1)
        p = (x + d * math.cos(a), y + d * math.sin(a))
        pts.append([round(v * 4) / 4 for v in p] if k % 4 == 0 else list(p))
    return [*pts, pts[0]]


def brute(x, y, rings):
    """2 on an edge, 1 inside, 0 outside."""
    turns = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and abs(cross) <= 1e-12:
                return 2
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                turns = not turns
    return int(turns)


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(1)
    polygons = [(k, [star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.5, 3), rng.randrange(5, 40))]) for k in range(12)]
    outer = [[-4.0, -4.0], [4.0, -4.0], [4.0, 4.0], [-4.0, 4.0], [-4.0, -4.0]]
    hole = [[-1.0, -1.0], [-1.0, 1.5], [1.25, 1.5], [1.25, -1.0], [-1.0, -1.0]]
    polygons += [(12, [outer, hole]), (13, [[[0.5, 0.5], [0.5, 0.5], [2.5, 0.5], [2.5, 2.5], [0.5, 2.5], [0.5, 0.5]]])]
    points = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(600)] + [(a / 4, b / 4) for a in range(-18, 19, 2) for b in range(-18, 19, 2)]
    points += [tuple(p) for _, rings in polygons for ring in rings for p in ring[:3]]
    points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for _, rings in polygons for ring in rings for a, b in zip(ring, ring[1:], strict=False)]
    return polygons, points, spatial.edges_of(spark.createDataFrame(polygons, RINGS)), spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "pid int, lat double, lon double")


@pytest.mark.parametrize("step", [0.25, 0.3, 1.0, 7.0])
def test_polygons_of_points(spark, shapes, step):
    """Overlaps, holes, double corners, points on corners, edges and borders of cells."""
    polygons, points, edges, df = shapes
    got = {r.pid: r.poly_id for r in spatial.tag_polygons(df, edges, ["pid"], step).collect()}
    assert got == {i: max((k for k, rings in polygons if brute(x, y, rings)), default=None) for i, (x, y) in enumerate(points)}


def test_cells_know_their_edges_alone(spark, shapes):
    """A cell is inside, touched by its own edges, or not there; no edge lies beside its cell."""
    polygons, _, edges, _ = shapes
    step = 0.5
    cells, own = (d.collect() for d in spatial.polygon_cells(edges, step))
    inside = {(r.poly_id, r.gx, r.gy): r.inside for r in cells}
    for k, rings in polygons:
        for gx in range(-12, 12):
            for gy in range(-12, 12):
                want = brute((gx + 0.5) * step, (gy + 0.5) * step, rings)
                if want < 2:
                    assert inside.get((k, gx, gy), False) == bool(want)
    for r in own:
        x0, y0 = r.gx * step - 1e-6, r.gy * step - 1e-6
        lows, highs = (max(min(a, b), c) for a, b, c in ((r.x1, r.x2, x0), (r.y1, r.y2, y0))), (min(max(a, b), c + step + 2e-6) for a, b, c in ((r.x1, r.x2, x0), (r.y1, r.y2, y0)))
        assert all(low <= high for low, high in zip(lows, highs, strict=True))
    met = spark.createDataFrame(own).groupBy("poly_id", "gx", "gy").count().agg(F.max("count")).first()[0]
    assert met < 20 and sum(not r.inside for r in cells) < len(cells)
    assert spatial.tag_polygons(spark.createDataFrame([(0, 1.0, 1.0)], "pid int, lat double, lon double"), edges.limit(0), ["pid"]).first().poly_id is None


def sphere(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    return 2 * 6371 * math.asin(math.sqrt(min(1, math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))


def flat(a, b):
    return math.hypot((a[0] - b[0]) * 110.57, (a[1] - b[1]) * 111.32 * math.cos(math.radians(22.5)))


@pytest.mark.parametrize(("distance", "km"), [(spatial.haversine_km, sphere), (spatial.flat_km, flat)])
def test_nearest_places_anywhere(spark, distance, km):
    """Towns in dense clusters, at the poles, on both sides of the date line and on one spot; points near, far and at the antipodes."""
    rng = random.Random(2)
    towns = [(21 + rng.gauss(0, 0.02), 92 + rng.gauss(0, 0.02)) for _ in range(700)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    towns += [(89.99, a) for a in (-170.0, 10.0, 100.0)] + [(-89.5, 5.0)] + [(0.0 + k / 100, s * 179.995) for k in range(5) for s in (1, -1)] + [towns[3]] * 40
    spots = [(21 + rng.gauss(0, 0.05), 92 + rng.gauss(0, 0.05)) for _ in range(150)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    spots += [(90.0, 0.0), (-90.0, 77.0), (0.003, 180.0), (0.003, -180.0), (-21.0, -88.0), (89.9, -171.0), towns[3], (22.0, 93.5)]
    places = spark.createDataFrame([(i, f"t{i}", *t) for i, t in enumerate(towns)], "place_id int, name string, lat double, lon double")
    got = {r.pid: r for r in spatial.nearest_place(spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "pid int, lat double, lon double"), places, ["pid"], distance).collect()}
    assert len(got) == len(spots)
    for i, p in enumerate(spots):
        ranked = sorted((km(p, t), k) for k, t in enumerate(towns))
        assert got[i].km == pytest.approx(ranked[0][0], abs=1e-5)
        # The last digits of equal distances may differ; of places on one spot the first counts.
        place = int(got[i].place[1:])
        assert place in {k for d, k in ranked if d <= ranked[0][0] + 1e-7} and place == towns.index(towns[place])


def test_cubes_are_split_where_places_are_dense(spark, monkeypatch):
    """What points meet doesn't grow with a cluster that is far from them."""
    seen = {}
    real = spatial.written
    monkeypatch.setattr(spatial, "written", lambda df, label: seen.setdefault(label, real(df, label)))
    rng = random.Random(3)
    towns = [(i, f"t{i}", 21 + rng.gauss(0, 0.3), 92 + rng.gauss(0, 0.3)) for i in range(4000)]
    spots = [(i, 0.0 + rng.uniform(-5, 5), 120 + rng.uniform(-5, 5)) for i in range(50)]
    spatial.nearest_place(spark.createDataFrame(spots, "pid int, lat double, lon double"), spark.createDataFrame(towns, "place_id int, name string, lat double, lon double"), ["pid"]).collect()
    last = seen[max((k for k in seen if k.startswith("rows")), key=lambda k: int(k[4:]))]
    assert last.agg(F.max(F.size("_left"))).first()[0] <= 12 and len(seen) > 6


@pytest.mark.parametrize("radius", [0, 1, 5, 40])
def test_window_sums_of_any_radius(spark, radius):
    rng = np.random.default_rng(4)
    values = rng.integers(-5, 50, (23, 31)).astype(float)
    gone = {(3, 4), (22, 30), (0, 0), (10, 0)}
    raster = spark.createDataFrame([(r + 100, c - 7, float(values[r, c])) for r in range(23) for c in range(31) if (r, c) not in gone], "row long, col long, value double")
    for r, c in gone:
        values[r, c] = 0
    values = np.maximum(values, 0)
    at = [(r, c) for r in (-60, -3, 0, 1, 11, 22, 24, 70) for c in (-50, -2, 0, 1, 15, 30, 33, 80)]
    got = {r.pid: r.people for r in spatial.box_population(spark.createDataFrame([(i, r + 100, c - 7) for i, (r, c) in enumerate(at)], "pid int, row long, col long"), raster, ["pid"], radius).collect()}
    for i, (r, c) in enumerate(at):
        assert got[i] == values[max(0, r - radius) : max(0, r + radius + 1), max(0, c - radius) : max(0, c + radius + 1)].sum()
    assert spatial.box_population(spark.createDataFrame([(1, 1, 1)], "pid int, row long, col long"), raster.limit(0), ["pid"], 2).first().people == 0.0


def test_projection_round_trips_and_known_places(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-80, 84), rng.uniform(-180, 179.99)) for i in range(400)] + [(400, 0.0, 3.0), (401, 0.0, -180.0), (402, 60.0, 9.0), (403, 43.642567, -79.387139)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double").withColumn("epsg", projection.epsg_of(F.col("lat"), F.col("lon")))
    east, north = projection.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    df = df.withColumn("east", east).withColumn("north", north)
    lat, lon = projection.from_utm(F.col("east"), F.col("north"), F.col("epsg"))
    got = {r.id: r for r in df.withColumn("lat2", lat).withColumn("lon2", lon).collect()}
    for r in got.values():
        assert abs(r.lat - r.lat2) * 111_000 < 1e-3 and abs(r.lon - r.lon2) * 111_000 < 1e-3
        assert (r.epsg >= 32700) == (r.lat < 0) and abs(r.east - 500_000) < 350_000
    assert (got[400].epsg, round(got[400].east, 6), round(got[400].north, 6)) == (32631, 500_000.0, 0.0) and got[401].epsg == 32601
    # The meridian's arc, by numerical integration of the ellipsoid.
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    phi = np.linspace(0, math.radians(60), 200_001)
    arc = np.trapezoid(projection.A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert abs(got[402].north - 0.9996 * arc) < 1e-3
    assert (got[403].epsg, round(got[403].east), round(got[403].north)) == (32617, 630084, 4833439)


def test_lattice_of_a_cell(spark):
    """Sides are multiples of 40 m, the size is the extent over 40, and the whole cell lies within."""
    box = spark.createDataFrame([(92.40, 21.72, 92.42, 21.74)], "w double, s double, e double, n double")
    r = box.select(projection.lattice(F.col("w"), F.col("s"), F.col("e"), F.col("n"), F.lit(32646)).alias("l")).first().l
    assert all(v % 40 == 0 for v in (r.x0, r.y0, r.x1, r.y1)) and (r.height, r.width) == ((r.y1 - r.y0) / 40, (r.x1 - r.x0) / 40)
    edge = [(21.72 + 0.02 * k / 50, 92.40 + 0.02 * j / 50) for k in range(51) for j in (0, 50)] + [(21.72 + 0.02 * k / 50, 92.40 + 0.02 * j / 50) for j in range(51) for k in (0, 50)]
    pts = spark.createDataFrame(edge, "lat double, lon double")
    east, north = projection.to_utm(F.col("lat"), F.col("lon"), F.lit(32646))
    b = pts.agg(F.min(east), F.max(east), F.min(north), F.max(north)).first()
    assert r.x0 <= b[0] < r.x0 + 40 and r.x1 - 40 < b[1] <= r.x1 and r.y0 <= b[2] < r.y0 + 40 and r.y1 - 40 < b[3] <= r.y1


def test_scenes_of_one_projection(spark):
    """The first scene's projection counts; later places move up among those of it, so that the eighth of them is still looked at."""
    rows = [("c", "pre", s, s, 32646 if s == 1 or s > 4 else 32645, p, 0, 100.0 + s, 50.0, 4 if s > 5 else 9) for s in range(1, 13) for p in range(4)]
    pixels = spark.createDataFrame(rows, "cell string, window string, scene int, place int, epsg int, row int, col int, nir double, swir double, scl int")
    kept = imagery.same_projection(pixels.select("cell", "window", "scene", "place", "epsg").distinct()).collect()
    assert {(r.scene, r.place) for r in kept} == {(1, 1), *((s, s - 3) for s in range(5, 13))}
    assert {r.scene for r in imagery.choose_scenes(pixels, [4]).collect()} == {6, 7, 8}
    assert {r.scene for r in imagery.choose_scenes(pixels.drop("epsg"), [4]).collect()} == {6, 7, 8}
    assert imagery.nbr_composite(pixels, [4]).count() == 4


def encode_png(image, filters, colour=2, bits=8, palette=None):
    """PNG bytes with a filter for each row in turn."""
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    rows = image.reshape(h, w * channels).astype(f">u{bits // 8}").view(np.uint8).reshape(h, -1).astype(int)
    px, raw = channels * bits // 8, b""
    for k in range(h):
        kind, line, up = filters[k % len(filters)], rows[k], rows[k - 1] if k else np.zeros_like(rows[0])
        left, corner = np.concatenate([np.zeros(px, int), line[:-px]]), np.concatenate([np.zeros(px, int), up[:-px]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        out = line - [0 * line, left, up, (left + up) // 2, paeth][kind]
        raw += bytes([kind]) + (out % 256).astype(np.uint8).tobytes()
    def chunk(kind, body):  # noqa: E306
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    packed = zlib.compress(raw)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0))] + ([chunk(b"PLTE", palette.tobytes())] if palette is not None else [])
    return png.SIGNATURE + b"".join([*parts, chunk(b"IDAT", packed[:40]), chunk(b"IDAT", packed[40:]), chunk(b"IEND", b"")])


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4, 4, 3]], ids=str)
def test_png_filters(filters):
    image = np.random.default_rng(6).integers(0, 256, (13, 17, 3), dtype=np.uint8)
    assert np.array_equal(png.decode(encode_png(image, filters)), image)


def test_png_kinds_of_colour():
    rng = np.random.default_rng(7)
    grey, alpha, deep = rng.integers(0, 256, (5, 6), dtype=np.uint8), rng.integers(0, 256, (5, 6, 4), dtype=np.uint8), rng.integers(0, 65536, (5, 6, 3), dtype=np.uint16)
    palette, index = rng.integers(0, 256, (10, 3), dtype=np.uint8), rng.integers(0, 10, (5, 6), dtype=np.uint8)
    assert np.array_equal(png.decode(encode_png(grey, [4], 0)), np.repeat(grey[..., None], 3, axis=2))
    assert np.array_equal(png.decode(encode_png(alpha, [1, 3], 6)), alpha[..., :3])
    assert np.array_equal(png.decode(encode_png(deep, [2, 4], 2, 16)), deep >> 8)
    assert np.array_equal(png.decode(encode_png(index, [0], 3, palette=palette)), palette[index])
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


def test_elevation_from_tile_files(spark, tmp_path):
    """Files to a mosaic of elevations: the whole path of a tile."""
    rng = np.random.default_rng(8)
    tiles = {(20 + x, 10 + y): rng.integers(0, 256, (256, 256, 3), dtype=np.uint8) for x in (0, 1) for y in (0, 1)}
    for (x, y), image in tiles.items():
        (tmp_path / f"{x}_{y}.png").write_bytes(encode_png(image, [0, 1, 2, 3, 4]))
    files = spark.read.format("binaryFile").load(str(tmp_path)).repartition(4)
    px = spatial.decode_png_tiles(files)
    placed = px.select(F.regexp_extract("path", r"(\d+)_\d+\.png", 1).cast("int").alias("tx"), F.regexp_extract("path", r"\d+_(\d+)\.png", 1).cast("int").alias("ty"), "r", "c", spatial.tile_elevation(F.col("red"), F.col("green"), F.col("blue")).alias("value"))
    got = np.full((512, 512), np.nan)
    for r in spatial.mosaic(placed, 20, 10).toPandas().itertuples():
        got[r.row, r.col] = r.value
    want = np.block([[tiles[20 + x, 10 + y].astype(float) @ [256.0, 1.0, 1 / 256] - 32768 for x in (0, 1)] for y in (0, 1)])
    assert np.array_equal(got, want)
