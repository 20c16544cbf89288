"""Distances, polygons, rasters, images, the recent window, readers and writers."""

import datetime as dt
import itertools
import json
import math
import random
import struct
import zlib
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillspan import api
from quillspan.functions import stats
from quillspan.operators import imagery, live, spatial
from quillspan.plans import places as plans
from quillspan.sources import readers, writers
from quillspan.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_haversine_is_the_angle_between_unit_vectors(spark):
    rng = random.Random(1)
    for _ in range(5):
        a, b = ((rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(2))
        x, y = ([math.cos(math.radians(t)) * math.cos(math.radians(u)), math.cos(math.radians(t)) * math.sin(math.radians(u)), math.sin(math.radians(t))] for t, u in (a, b))
        km = 6371 * math.acos(sum(p * q for p, q in zip(x, y, strict=True)))
        assert one(spark, spatial.haversine_km(*map(F.lit, (*a, *b)))) == pytest.approx(km, rel=1e-6)


def test_point_in_polygon_with_a_hole(spark):
    pts = spark.createDataFrame([(0, 21.2, 92.22), (1, 21.2, 92.3), (2, 21.05, 92.05), (3, 30.0, 92.0)], "pid int, lat double, lon double")
    got = {r.pid: r.poly_id for r in spatial.tag_polygons(pts, spatial.edges_of(plans.polygons(spark)), ["pid"], 0.1).collect()}
    assert got == {0: 1, 1: None, 2: 0, 3: None}
    # Corners and edges belong to the polygon, those of a hole too; of two polygons that share an edge the larger number counts.
    edge = [(0, 21.3, 92.4), (1, 21.1, 92.3), (2, 21.2, 92.4), (3, 21.16, 92.3), (4, 21.4, 92.0), (5, 21.2, 92.125), (6, 21.4001, 92.0)]
    got = {r.pid: r.poly_id for r in spatial.tag_polygons(spark.createDataFrame(edge, "pid int, lat double, lon double"), spatial.edges_of(plans.polygons(spark)), ["pid"], 0.1).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: None}


def test_nearest_place_ties_go_to_the_first(spark):
    pts = spark.createDataFrame([(0, 21.2, 92.02)], "pid int, lat double, lon double")
    assert spatial.nearest_place(pts, plans.places(spark), ["pid"]).first().place == "west"


def test_nearest_place_against_brute_force(spark):
    """Dense towns and empty country, near the equator, the poles and the date line, with ties."""
    rng = random.Random(17)
    towns = [(i, f"t{i}", 21.0 + rng.random(), 92.0 + rng.random()) for i in range(40)] + [(40 + i, f"f{i}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)]
    towns += [(100, "east", 0.0, 179.9), (101, "pole", 88.9, 10.0), (102, "twin", *towns[0][2:]), (103, "(unnamed)", 21.5, 92.5)]
    spots = [(i, 21.0 + rng.random(), 92.0 + rng.random()) for i in range(40)] + [(40 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)] + [(120, 0.1, -179.95), (121, 88.0, -170.0), (122, *towns[0][2:])]
    points, places = spark.createDataFrame(spots, "pid int, lat double, lon double"), spark.createDataFrame(towns, "place_id int, name string, lat double, lon double")

    def sphere(a, b):
        p, q = math.radians(a[1]), math.radians(b[2])
        return 2 * 6371 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[2]) / 2) ** 2))

    for named in (False, True):
        known = [t for t in towns if not named or t[1] != "(unnamed)"]
        got = {r.pid: r for r in spatial.nearest_place(points, places, ["pid"], named_only=named).collect()}
        for s in spots:
            km, _, name = min((round(sphere(s, t), 9), t[0], t[1]) for t in known)
            assert (got[s[0]].place, got[s[0]].km) == (name, pytest.approx(km, abs=1e-6))
    assert spatial.nearest_place(points, places.limit(0), ["pid"]).count() == 0


def test_footprints_of_ragged_rasters(spark):
    rng = random.Random(5)
    pixels = [(i, j, rng.uniform(0, 30)) for i in range(8) for j in range(9) if (i, j) != (6, 6)]
    spots = [(i * 20 + j, i, j) for i in range(-1, 9) for j in range(-1, 10)]
    raster, points = spark.createDataFrame(pixels, "row int, col int, slope double"), spark.createDataFrame(spots, "pid int, row int, col int")
    value = {(i, j): v for i, j, v in pixels}
    for r in spatial.footprint_slope(points, raster, ["pid"], 1).collect():
        _, i, j = next(s for s in spots if s[0] == r.pid)
        near = [value.get((i + a, j + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        want = (None, None) if None in near else (pytest.approx(sum(near) / 9), pytest.approx(sum(v >= 15 for v in near) / 9))
        assert (r.mean_slope, r.steep_share) == want


def test_slope_of_a_plane(spark):
    plane = spark.createDataFrame([(i, j, 30.0 * j) for i in range(4) for j in range(4)], "row int, col int, value double")
    assert all(abs(r.slope - 45) < 1e-9 for r in spatial.slope(plane, F.lit(30.0)).collect())


def test_mercator_round_trip(spark):
    lat = one(spark, spatial.pixel_lat(F.lit(10), 1780, 12))
    y = one(spark, spatial.tile_y(F.lit(lat), 12))
    assert abs((y - 1780) * 256 - 10.5) < 1e-6


def test_snap(spark):
    lo, hi = spatial.snap(F.lit(81.0), F.lit(119.0))
    assert one(spark, lo) == 80 and one(spark, hi) == 120


def test_threshold_matrix_and_groups_against_brute_force(spark):
    rng = random.Random(13)
    verdicts = ["scar visible", "no clear scar", "no clear imagery"]
    rows = [(rng.choice("xyz"), rng.choice(verdicts), *[round(rng.uniform(0, 0.2), 3) for _ in range(4)], rng.random()) for _ in range(60)]
    cells = spark.createDataFrame(rows, "group string, verdict string, scar_share_10 double, scar_share_20 double, scar_share_27 double, scar_share_44 double, clear_share double").withColumn("scar_share", F.col("scar_share_27"))
    groups = {r.group: r for r in imagery.group_summary(cells).collect()}
    for g in "xyz":
        mine = [r for r in rows if r[0] == g]
        clear = [r for r in mine if r[1] != "no clear imagery"]
        assert (groups[g].cells, groups[g].with_imagery, groups[g].visible) == (len(mine), len(clear), sum(r[1] == "scar visible" for r in mine))
        assert groups[g].scar_share_median == pytest.approx(median(r[4] for r in clear))
    for r in imagery.threshold_matrix(cells).collect():
        k = 2 + [10, 20, 27, 44].index(r.threshold)
        assert r.cells == sum(x[0] == r.group and x[1] != "no clear imagery" and x[k] >= r.share for x in rows)


def test_early_stop_of_scenes(spark):
    px = spark.createDataFrame([(0, "pre", s, s, p, 4 if p >= bad else 9) for s, bad in ((0, 0), (1, 5), (2, 0), (3, 0), (4, 0)) for p in range(10)], "cell int, window string, scene int, place int, p int, scl int")
    assert sorted(r.scene for r in imagery.choose_scenes(px, [4]).collect()) == [0, 2, 3]


def test_confidence_and_same_day(spark):
    words = {"l": 20.0, "n": 60.0, "h": 90.0, "0": 0.0, "13": 13.0, "41.5": 41.5, "low": None, "": None, None: None}
    df = spark.createDataFrame([(w,) for w in words], "c string")
    assert {r.c: r.v for r in df.select("c", live.decode_confidence(F.col("c")).alias("v")).collect()} == words
    for day, year in itertools.product([dt.date(2020, 2, 29), dt.date(2020, 2, 28), dt.date(2021, 12, 31), dt.date(2019, 7, 4)], [2012, 2016, 2017, 2100]):
        try:
            want = day.replace(year=year)
        except ValueError:
            want = dt.date(year, 2, 28)
        assert one(spark, live.same_day(F.lit(day), F.lit(year))) == want


@pytest.fixture(scope="module")
def week():
    """Two weeks of detections over a few cells, some on static sources, and a grid of half the cells."""
    rng = random.Random(23)
    rows = []
    for i in range(300):
        lat, lon = 10.0 + rng.randrange(60) * 0.01 + 0.004, 50.0 + rng.randrange(40) * 0.01 + 0.006
        rows.append((i, dt.date(2019, 6, 1) + dt.timedelta(days=rng.randrange(15)), f"{rng.randrange(24):02d}{rng.randrange(60):02d}", lat, lon, rng.uniform(0, 50), 0))
    grid = [(i, j, round((i + 0.5) * 0.02, 6), round((j + 0.5) * 0.02, 6), rng.uniform(0, 30), rng.uniform(0, 500)) for i in range(500, 530) for j in range(2500, 2520) if (i + j) % 2]
    hot = [(2, 10.104, 50.106), (3, 10.404, 50.306)]
    return rows, grid, hot


def test_live_build_against_brute_force(spark, week):
    rows, grid, hot = week
    df = spark.createDataFrame(rows, "id long, date date, hhmm string, lat double, lon double, frp double, kind int")
    cells = spark.createDataFrame(grid, "ci long, cj long, lat double, lon double, slope_mean double, population double")
    static = live.static_cells(spark.createDataFrame(hot, "kind int, lat double, lon double"))
    lists = spark.createDataFrame([(*grid[k][:2], p, s) for k, p, s in ((0, "inspect first", 2018), (0, "inspect first", 2017), (5, "inspect", 2018))], "ci long, cj long, priority string, season int")
    towns = [(0, "a", 10.1, 50.1), (1, "b", 10.5, 50.3), (2, "(unnamed)", 10.3, 50.2)]
    places = spark.createDataFrame(towns, "place_id int, name string, lat double, lon double")
    made = live.build(df, static, cells, live.listed_seasons(lists), places, df, [2018, 2019], str(max(r[1] for r in rows)))
    near = {(math.floor(a / 0.01) + x, math.floor(o / 0.01) + y) for _, a, o in hot for x in (-1, 0, 1) for y in (-1, 0, 1)}
    last = max(r[1] for r in rows)
    recent = [r for r in rows if r[1] > last - dt.timedelta(days=7)]
    still = lambda r: (math.floor(r[3] / 0.01), math.floor(r[4] / 0.01)) in near
    ground = {g[:2]: g for g in grid}
    at = lambda r: (math.floor(r[3] / 0.02), math.floor(r[4] / 0.02))
    free = [r for r in recent if not still(r)]
    hills = [r for r in free if at(r) in ground]
    wanted = lambda c: ground[c][4] >= 15 and ground[c][5] >= 200 or c == grid[0][:2]
    one = made["counts"].first()
    assert (one.fires, one.hills, one.check, one.static) == (len(free), len(hills), sum(wanted(at(r)) for r in hills), sum(map(still, recent)))
    assert one.normal == sum(at(r) in ground for r in free) / 2 and (one["from"], one.to) == (last - dt.timedelta(days=6), last)
    alerts = made["alerts"].collect()
    assert {(r.ci, r.cj): r.fires for r in alerts} == Counter(map(at, hills))
    flat = lambda g, t: math.hypot((g[2] - t[2]) * 110.57, (g[3] - t[3]) * 111.32 * math.cos(math.radians(22.5)))
    for r in alerts:
        g = ground[r.ci, r.cj]
        km, name = min((flat(g, t), t[1]) for t in towns[:2])
        mine = sorted((x[1], x[2]) for x in hills if at(x) == (r.ci, r.cj))
        assert (r.place, r.km, r.check) == (name, pytest.approx(km, abs=0.051), wanted((r.ci, r.cj)))
        assert ((r.first.date, r.first.hhmm), (r["last"].date, r["last"].hhmm)) == (mine[0], mine[-1])
    keys = [(r.seasons is None, not r.check, -r.slope_mean) for r in alerts]
    assert keys == sorted(keys)
    levels = Counter(r.level for r in made["fires"].collect())
    assert levels == Counter(2 if at(r) in ground and wanted(at(r)) else 1 if at(r) in ground else 0 for r in free)
    none = live.build(df.limit(0), static, cells, live.listed_seasons(lists), places, df, [2018], None)["counts"].first()
    assert none.fires == 0 and none.to == dt.date.today() and none.normal == 0


def test_the_week_ends_with_the_file_not_with_the_region(spark, week):
    """The newest detection lies outside the region: the window doesn't slide back to the region's own last day."""
    rows, grid, _ = week
    df = spark.createDataFrame(rows, "id long, date date, hhmm string, lat double, lon double, frp double, kind int")
    newest = max(r[1] for r in rows)
    later = str(newest + dt.timedelta(days=4))
    got = {r.id for r in live.window(df, later).collect()}
    assert got == {r[0] for r in rows if r[1] > newest - dt.timedelta(days=3)} and got != {r.id for r in live.window(df, str(newest)).collect()}
    assert live.window(df, str(newest + dt.timedelta(days=7))).count() == 0


def test_live_reader_clips_after_taking_the_last_date(spark, tmp_path):
    names = "latitude longitude bright_ti4 scan track acq_date acq_time satellite confidence version bright_ti5 frp daynight".split()
    rows = [(51.5, 0.1, "2018-11-09", "5"), (10.2, 50.3, "2018-11-07", "1207"), (10.9, 50.9, "2018-11-08", "45"), (9.0, 50.3, "2018-11-06", "900")]
    lines = [",".join(str({"latitude": a, "longitude": o, "acq_date": d, "acq_time": t}.get(n, 1)) for n in names) for a, o, d, t in rows]
    (tmp_path / "live.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    df, last = readers.read_live(spark, str(tmp_path / "live.csv"), (50.0, 10.0, 51.0, 11.0))
    assert last == "2018-11-09" and sorted(r.acq_time for r in df.collect()) == ["0045", "1207"]
    (tmp_path / "error.csv").write_text("Invalid key.\n")
    with pytest.raises(ValueError):
        readers.read_live(spark, str(tmp_path / "error.csv"), (50.0, 10.0, 51.0, 11.0))


def test_archive_reader_skips_what_is_missing(spark, tmp_path):
    head = "latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight,type"
    (tmp_path / "a.csv").write_text(f"{head}\n22.0,92.4,300,1,1,2002-03-02,733,Aqua,M,80,6,290,1.5,D,0\n")
    (tmp_path / "empty.csv").write_text("")
    got = readers.normalise(readers.read_archive(spark, {"A": ([str(tmp_path / n) for n in ("a.csv", "empty.csv", "none.csv")], readers.ARCHIVE_A)})).collect()
    assert len(got) == 1 and (got[0].sensor, got[0].hhmm, got[0].conf, str(got[0].date)) == ("A", 733, 80.0, "2002-03-02")
    with pytest.raises(FileNotFoundError):
        readers.read_archive(spark, {"A": ([str(tmp_path / "none.csv")], readers.ARCHIVE_A)})


def test_polygon_and_settlement_readers(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    shapes = [{"type": "Feature", "properties": {"shapeName": "one"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"type": "Feature", "properties": {"shapeName": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    assert {r.name: len(r.rings) for r in readers.read_polygons(spark, str(tmp_path / "p.json")).collect()} == {"one": 1, "two": 2}
    tags = [{"name:en": "A", "name": "B"}, {"name:en": "", "name": "B"}, {"place": "village"}]
    (tmp_path / "s.json").write_text(json.dumps({"elements": [{"type": "node", "id": i, "lat": 1.0, "lon": 2.0, "tags": t} for i, t in enumerate(tags)]}))
    assert [r.name for r in readers.read_settlements(spark, str(tmp_path / "s.json")).orderBy("place_id").collect()] == ["A", "B", "(unnamed)"]


def test_paged_source(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,satellite,confidence,frp,daynight"
    for day, lines in (("2025-01-01", ["1,2,2025-01-01,733,N,n,1,D"] * 2), ("2025-01-03", []), ("2025-01-05", ["1,2,2025-01-06,733,N,n,1,D"])):
        (tmp_path / f"{day}.csv").write_text("\n".join([head, *lines]) + "\n")
    url = f"file://{tmp_path}/{{start}}.csv"
    got = readers.fetch_days(spark, "2025-01-01", "2025-01-05", url=url, page="2").collect()
    assert [(r.acq_date, r.latitude, r.acq_time) for r in got] == [("2025-01-01", "1", "733")]
    square = lambda a: spatial.edges_of(spark.createDataFrame([(0, [[[a, 0.0], [a + 3, 0.0], [a + 3, 3.0], [a, 3.0], [a, 0.0]]])], "poly_id int, rings array<array<array<double>>>"))
    assert [readers.fetch_days(spark, "2025-01-01", "2025-01-05", square(a), url=url, page="2").count() for a in (0.0, 10.0)] == [1, 0]


def test_keys_availability_and_last_day(spark, tmp_path, monkeypatch):
    env = tmp_path / ".env"
    monkeypatch.delenv("SOME_KEY", raising=False)
    with pytest.raises(LookupError):
        readers.access_key("SOME_KEY", str(env))
    env.write_text("# note\nOTHER=1\nSOME_KEY = 'from file'\n")
    assert readers.access_key("SOME_KEY", str(env)) == "from file"
    monkeypatch.setenv("SOME_KEY", "from environment")
    assert readers.access_key("SOME_KEY", str(env)) == "from environment"
    (tmp_path / "a.csv").write_text("data_id,min_date,max_date\nX_NRT,2020-01-01,2025-03-02\nX_SP,2012-01-01,2024-12-31\nX_NRT,2020-01-01,2025-03-04\n")
    days = {r["product"]: r.last_day for r in readers.read_availability(spark, str(tmp_path / "a.csv")).collect()}
    assert days == {"X_NRT": "2025-03-04", "X_SP": "2024-12-31"} and writers.watermark(days) == "2024-12-31"
    assert readers.last_day(spark, str(tmp_path / "none.json"), "2001-11-30") == "2001-11-30"
    (tmp_path / "end.json").write_text('{"data_end": "2002-01-05"}')
    assert readers.last_day(spark, str(tmp_path / "end.json"), "2001-11-30") == "2002-01-05"


def geotiff(values, west, north, step, order="<", deflate=False):
    """A one-band file, two rows to a strip."""
    height, width = len(values), len(values[0])
    strips = [struct.pack(f"{order}{width * len(part)}f", *sum(part, [])) for part in (values[k : k + 2] for k in range(0, height, 2))]
    strips = [zlib.compress(x) if deflate else x for x in strips]
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [32]), (259, 3, [8 if deflate else 1]), (273, 4, None), (278, 3, [2]), (279, 4, [len(x) for x in strips]), (339, 3, [3]), (33550, 12, [step, step, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
    kinds, extra, at = {3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}, b"", 8 + 2 + 12 * len(tags) + 4
    begin = at + 200
    places = [begin + sum(map(len, strips[:k])) for k in range(len(strips))]
    entries = b""
    for tag, kind, value in tags:
        value = places if value is None else value
        code, size = kinds[kind]
        raw = struct.pack(f"{order}{len(value)}{code}", *value)
        if len(raw) > 4:
            entries += struct.pack(f"{order}HHII", tag, kind, len(value), at + len(extra))
            extra += raw
        else:
            entries += struct.pack(f"{order}HHI", tag, kind, len(value)) + raw.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", 0)
    return (head + extra).ljust(begin, b"\0") + b"".join(strips)


@pytest.mark.parametrize(("order", "deflate"), [("<", False), (">", True)])
def test_population_raster(spark, tmp_path, order, deflate):
    values = [[1.5, -99.0, 3.0], [4.0, 5.0, 6.0], [7.0, 0.0, 9.0]]
    (tmp_path / "p.tif").write_bytes(geotiff(values, 90.0, 25.0, 0.5, order, deflate))
    got = {(r.row, r.col): (r.lat, r.lon, r.value) for r in readers.read_geotiff(spark, str(tmp_path / "p.tif")).collect()}
    assert got == {(i, j): (25.0 - (i + 0.5) * 0.5, 90.0 + (j + 0.5) * 0.5, max(v, 0.0)) for i, line in enumerate(values) for j, v in enumerate(line)}
    spots = readers.raster_position(spark.createDataFrame([(24.4, 91.2)], "lat double, lon double"), 25.0, 90.0, 0.5).first()
    assert (spots.row, spots.col) == (1, 2)


def test_window_off_the_raster_is_zero(spark):
    raster = spark.createDataFrame([(i, j, 10 * i + j) for i in range(1, 4) for j in range(1, 4)], "row int, col int, value int")
    got = {(r.row, r.col): r.value for r in spatial.read_window(raster, 2, -1, 3, 4).collect()}
    assert got == {(i, j): (10 * (i + 2) + j - 1 if 1 <= i + 2 <= 3 and 1 <= j - 1 <= 3 else 0) for i in range(3) for j in range(4)}


def test_image_sample_kit_and_staleness(spark):
    rows = [(i, i % 7, i + 1, i % 3, 20.0 if i % 2 else 5.0) for i in range(60)]
    cells = spark.createDataFrame(rows, "ci long, cj long, rank int, fire_days int, slope_p90 double")
    recent = spark.createDataFrame([(i, i % 7) for i in range(60) if i % 5 == 0], "ci long, cj long")
    sample = imagery.sample_cells(cells, recent, 6, 4)
    got = sample.collect()
    by = {g: {r.ci for r in got if r.group == g} for g in ("priority", "fire", "control")}
    assert by["priority"] == {1, 2, 4, 5, 7, 8} and all(len(v) == 6 for v in by.values())
    assert not by["priority"] & by["fire"] and all(i % 3 for i in by["fire"]) and all(i % 2 and i % 5 for i in by["control"])
    assert sorted(map(tuple, got)) == sorted(map(tuple, imagery.sample_cells(cells, recent, 6, 4).collect()))
    sheet, key = imagery.blind_kit(sample, 9)
    assert [r.code for r in sheet.collect()] == [f"P{k:02d}" for k in range(1, 19)] and sheet.columns == ["code", "visible", "notes"]
    assert {(r.ci, r.group) for r in key.collect()} == {(r.ci, r.group) for r in got} and len({r.code for r in key.collect()}) == 18
    assert imagery.still_current(sample, sample).first()[0]
    assert not imagery.still_current(sample, imagery.sample_cells(cells.filter("ci != 4"), recent, 6, 4)).first()[0]


def test_one_sided_ranks(spark):
    rng = random.Random(41)
    for sizes in ((4, 5), (3, 12), (2, 9)):
        a, b = [rng.randrange(6) / 2 for _ in range(sizes[0])], [rng.randrange(5) / 2 for _ in range(sizes[1])]
        df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("c", 9.0), ("a", None)], "g string, v double")
        r = stats.mann_whitney_test(df, "g", "v", "a", "b").first()
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        assert r.u == (u if min(sizes) >= 3 else None) and (r.p is None) == (r.u is None)
    # Against every split of untied values.
    a, b = [3.0, 7.0, 8.0, 9.0], [1.0, 2.0, 4.0, 5.0, 6.0]
    r = stats.mann_whitney_test(spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double"), "g", "v", "a", "b").first()
    splits = [sum(x > y for x in s for y in set(a + b) - set(s)) for s in itertools.combinations(a + b, 4)]
    assert r.p == pytest.approx(sum(u >= r.u for u in splits) / len(splits))


def test_kendall_with_ties(spark):
    x, y = [1, 2, 3, 4, 5, 6, 7], [2.0, 2.0, 1.0, 3.0, 3.0, 3.0, 5.0]
    r = stats.kendall_theilsen(spark.createDataFrame(list(zip(x, y, strict=True)), "x int, y double"), "x", "y", with_p=True).first()
    s = sum((y[j] > y[i]) - (y[j] < y[i]) for i in range(7) for j in range(i + 1, 7))
    # The variance over every order of the tied values, by enumeration.
    orders = list(set(itertools.permutations(y)))
    sums = [sum((o[j] > o[i]) - (o[j] < o[i]) for i in range(7) for j in range(i + 1, 7)) for o in orders]
    variance = sum(v * v for v in sums) / len(sums)
    assert r.s == s and r.p == pytest.approx(math.erfc(s / math.sqrt(2 * variance)), rel=1e-9)
    untied = stats.kendall_theilsen(spark.createDataFrame(list(zip(x, [1.0, 3.0, 2.0, 4.0, 6.0, 5.0, 7.0], strict=True)), "x int, y double"), "x", "y", with_p=True).first()
    every = [sum((o[j] > o[i]) - (o[j] < o[i]) for i in range(7) for j in range(i + 1, 7)) for o in itertools.permutations(range(7))]
    assert untied.p == pytest.approx(sum(abs(v) >= untied.s for v in every) / len(every))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.23456, None)], "a int, b double, c string")
    assert writers.as_json(df).first().json == '{"a":1,"b":1.23456,"c":null}'
    assert json.loads(writers.as_arrays(df).first().json) == [1, 1.2346, None]
    odd = ['a "quoted" {"v":1}, \\', "line\nend", "", None, "é]"]
    rows = [(x, [x, "y"], i, dt.date(2020, 1, 1)) for i, x in enumerate(odd)]
    got = writers.as_arrays(spark.createDataFrame(rows, "s string, a array<string>, i int, d date")).collect()
    assert [json.loads(r.json) for r in got] == [[x, [x, "y"], i, "2020-01-01"] for x, _, i, _ in rows]
    years = spark.createDataFrame([("A", 2001, 1), ("A", 2002, 2)], "sensor string, year int, v int")
    writers.refresh_years(years, str(tmp_path / "t"))
    writers.refresh_years(years.filter("year = 2002").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert sorted((r.year, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2001, 1), (2002, 9)]
    assert writers.stale_years({2024: "2024-12-31", 2025: "2025-03-01"}, "2025-06-30", [2024, 2025, 2026]) == [2025, 2026]
    assert writers.watermark({"x": "2025-03-01", "y": "2025-02-01"}) == "2025-02-01"
    assert writers.report({"t": df}, str(tmp_path / "r.json"))["t"][0]["a"] == 1
    assert writers.read_report(spark, str(tmp_path / "r.json")) == {"t": [{"a": 1, "b": 1.23456, "c": None}]} and not (tmp_path / "r.json.part").exists()
    with pytest.raises(ValueError):
        writers.report({"t": years}, limit=1)


def test_facade(spark, tmp_path):
    t = api.Tables(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "grid"))
    assert t.health() == ["grid"] and t.table("grid").count() == 3 and t.optional("none") is None
    with pytest.raises(api.NotBuilt):
        t.table("none")
    grid = spark.createDataFrame([(1100, 4620)], "ci long, cj long")
    with pytest.raises(api.OutsideGrid):
        api.cell_history(grid, 0.0, 0.0, grid)
    assert api.cell_history(grid, 22.01, 92.41, grid).count() == 1
    lists = spark.createDataFrame([("observed", 2, "none", "Dx"), ("observed", 1, "inspect", "dX")], "kind string, rank int, priority string, district string")
    assert [r.rank for r in api.watchlist(lists, district="DX").collect()] == [1, 2] and api.map_rows(lists).count() == 1
    assert api.grid_rows(spark.createDataFrame([(1, 2, 0.12345)], "ci long, cj long, v double")).first().v == 0.123
    with pytest.raises(api.NotBuilt):
        t.report("model")
    assert t.optional_report("model") is None and api.validation(t) == dict.fromkeys(api.REPORTS)
    for bad in (lambda: api.fires(lists, 1980), lambda: api.watchlist(lists, kind="x"), lambda: api.watchlist(lists, limit=0), lambda: api.calendar(lists, "moon")):
        with pytest.raises(ValueError):
            bad()


def test_stream_counts_each_detection_once(spark, tmp_path):
    ts = dt.datetime(2026, 3, 1, 12)
    rows = [(1, ts, 22.0, 92.0), (1, ts, 22.0, 92.0), (2, ts, 22.0, 92.0), (3, ts + dt.timedelta(days=9), 22.0, 92.0)]
    spark.createDataFrame(rows, "id long, ts timestamp, lat double, lon double").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = watch.daily_cells(watch.arrivals(spark, str(tmp_path / "in"), "id long, ts timestamp, lat double, lon double"))
    watch.run_available(stream, lambda batch, n: got.extend(batch.collect()), str(tmp_path / "state"))
    assert [r.fires for r in got] == [2]


def test_pip_edges_are_finite():
    assert math.isfinite(sum(sum(map(sum, ring)) for _, rings in plans.TRIANGLE for ring in rings))
