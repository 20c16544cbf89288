"""The watch from a saved file, and over files that arrive: each batch reads its own files, and gives what a recomputation over everything gives."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan import runs
from quillspan.operators import live, spatial
from quillspan.sources import readers
from quillspan.streaming import watch

FIELDS = "id long, ts timestamp, date date, hhmm string, lat double, lon double, frp double, inside boolean"
STATIC = [(2, 10.104, 50.106), (3, 10.404, 50.306)]
TOWNS = [(0, "a", 10.1, 50.1), (1, "b", 10.5, 50.3), (2, "(unnamed)", 10.3, 50.2)]


def detections(rng, n, first_day, days):
    out = []
    for i in range(n):
        day, h, m = first_day + dt.timedelta(days=rng.randrange(days)), rng.randrange(24), rng.randrange(60)
        inside = rng.random() < 0.8
        lat, lon = 10.0 + rng.randrange(60) * 0.01 + 0.004, (50.0 if inside else 60.0) + rng.randrange(40) * 0.01 + 0.006
        out.append((rng.randrange(10**9) * 1000 + i, dt.datetime(day.year, day.month, day.day, h, m), day, f"{h:02d}{m:02d}", lat, lon, round(rng.uniform(0, 50), 2), inside))
    return out


@pytest.fixture
def ground(spark):
    rng = random.Random(4)
    grid = [(i, j, round((i + 0.5) * 0.02, 6), round((j + 0.5) * 0.02, 6), rng.uniform(0, 30), rng.uniform(0, 500)) for i in range(500, 530) for j in range(2500, 2520) if (i + j) % 2]
    past = spark.createDataFrame([(k, dt.date(2018, 6, 10), a, o, 0) for k, (_, a, o) in enumerate(STATIC)] + [(9, dt.date(2018, 6, 10), 10.234, 50.134, 0)], "id long, date date, lat double, lon double, kind int")
    hot = spark.createDataFrame([(90 + k, dt.date(2017, 1, 1), a, o, kind) for k, (kind, a, o) in enumerate(STATIC)], past.schema)
    lists = spark.createDataFrame([(*grid[k][:2], p, s) for k, p, s in ((0, "inspect first", 2018), (0, "inspect first", 2017), (5, "inspect", 2018))], "ci long, cj long, priority string, season int")
    return spark.createDataFrame(grid, "ci long, cj long, lat double, lon double, slope_mean double, population double"), past.unionByName(hot), lists, spark.createDataFrame(TOWNS, "place_id int, name string, lat double, lon double")


def same(a, b):
    assert a["counts"] == b["counts"] and a["alerts"] == b["alerts"] and sorted(map(str, a["fires"])) == sorted(map(str, b["fires"]))


def test_batches_read_their_own_files_and_give_the_whole(spark, ground, tmp_path):
    """Shuffled, late and repeated arrivals, a restart after each file, and a batch that is worked off again."""
    grid, past, lists, places = ground
    rng = random.Random(6)
    start = dt.date(2019, 6, 1)
    files = [detections(rng, 120, start, 4), detections(rng, 150, start + dt.timedelta(days=2), 5), detections(rng, 60, start + dt.timedelta(days=3), 12), detections(rng, 40, start + dt.timedelta(days=9), 3)]
    files[1] += rng.sample(files[0], 50)  # come again
    files[2] += [r for r in files[1] if r[2] >= start + dt.timedelta(days=5)]
    files[2].append((5, dt.datetime(2019, 6, 15, 0, 1), dt.date(2019, 6, 15), "0001", 10.0, 60.0, 1.0, False))  # the newest lies outside
    files[3] += rng.sample(files[0], 30)  # older than any window: dropped, as they were counted long ago
    for f in files:
        rng.shuffle(f)
    run = runs.Run(spark, str(tmp_path / "run"))
    lists.write.parquet(f"{run.root}/watchlist")
    seen, still = [], 0
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(f"{run.root}/in/{k}")
        progress = runs.live_stream(run, watch.arrivals(spark, f"{run.root}/in/*", FIELDS, files=1), grid, places, past, [2017, 2018], "a folder")
        assert sum(p["numInputRows"] for p in progress) == len(rows)  # nothing that came before is read again
        seen += rows
        whole = {r[0]: r for r in seen}.values()
        last = str(max(r[2] for r in whole))
        other = runs.Run(spark, str(tmp_path / f"batch{k}"))
        lists.write.parquet(f"{other.root}/watchlist")
        doc = runs.live(other, spark.createDataFrame([r for r in whole if r[7]], FIELDS), grid, places, past, [2017, 2018], "a folder", last)
        same(json.loads(open(f"{run.root}/live.json").read()), doc)
        assert doc["counts"]["to"] == last and doc["alerts"]
        still += doc["counts"]["static"]
    assert still
    cells = [f for f in (tmp_path / "run/live_week/cells").iterdir() if f.name.startswith("version")]
    assert len(cells) <= 2 and not any("day=2019-06-01" in str(p) or "part=2019-06-01" in str(p) for p in (tmp_path / "run/live_week").rglob("*"))


def test_state_of_days_that_left_the_window_expires(spark, ground, tmp_path):
    grid, past, lists, _ = ground
    rng, start = random.Random(7), dt.date(2019, 6, 1)
    static, listed = live.static_cells(past), live.listed_seasons(lists)
    kept = []
    for k in range(4):
        spark.createDataFrame(detections(rng, 40, start + dt.timedelta(days=10 * k), 3), FIELDS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        changes = watch.cell_days(watch.arrivals(spark, f"{tmp_path}/in/*", FIELDS, files=1), static, grid, listed)
        progress = watch.run_available(changes, lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/state", "update")
        kept.append(sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"]))
    assert max(kept) <= 1.5 * kept[0]  # the days of the last file, not those of all files
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.filter("kind = 'cell' and scope = 'outside'").select("first").distinct().count() == 1


def write_file(path, rows):
    names = "latitude longitude bright_ti4 scan track acq_date acq_time satellite confidence version bright_ti5 frp daynight".split()
    lines = [",".join(str({"latitude": a, "longitude": o, "acq_date": d, "acq_time": t, "satellite": "N", "confidence": "n", "daynight": "D"}.get(n, 1)) for n in names) for a, o, d, t in rows]
    path.write_text("\n".join([",".join(names), *lines]) + "\n")


def test_watch_from_a_saved_file(spark, ground, tmp_path):
    """From the file to the document: clipped to box and polygons, over the week that ends with the file's newest day, anywhere."""
    grid, past, lists, places = ground
    run = runs.Run(spark, str(tmp_path / "run"))
    lists.write.parquet(f"{run.root}/watchlist")
    square = [[(50.0, 10.0), (50.3, 10.0), (50.3, 10.5), (50.0, 10.5), (50.0, 10.0)]]
    edges = spatial.edges_of(spark.createDataFrame([(3, square)], "poly_id int, rings array<array<struct<x: double, y: double>>>").withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))))
    rows = [(10.014, 50.036, "2019-06-08", "5"), (10.014, 50.036, "2019-06-02", "1207"), (10.2, 50.1, "2019-06-07", "45"), (10.2, 50.35, "2019-06-08", "50"), (48.0, 2.0, "2019-06-12", "900"), (10.104, 50.106, "2019-06-09", "1")]
    write_file(tmp_path / "live.csv", rows)
    doc = runs.live_file(run, str(tmp_path / "live.csv"), (49.0, 9.0, 51.0, 11.0), edges, grid, places, past, [2017, 2018])
    assert (doc["counts"]["from"], doc["counts"]["to"]) == ("2019-06-06", "2019-06-12")
    assert (doc["counts"]["fires"], doc["counts"]["static"]) == (2, 1) and {f[3] for f in doc["fires"]} == {"0005", "0045"}
    assert doc["counts"]["normal"] == 0.5  # one detection of 2018 in the same week, in a cell of the grid or not
    (tmp_path / "none.csv").write_text((tmp_path / "live.csv").read_text().split("\n")[0] + "\n")
    assert runs.live_file(run, str(tmp_path / "none.csv"), (49.0, 9.0, 51.0, 11.0), edges, grid, places, past, [2018])["counts"]["to"] == str(dt.date.today())


def test_a_large_week_is_a_table(spark, ground, tmp_path, monkeypatch):
    grid, past, lists, places = ground
    monkeypatch.setattr(runs, "INLINE_FIRES", 10)
    run = runs.Run(spark, str(tmp_path / "run"))
    lists.write.parquet(f"{run.root}/watchlist")
    df = spark.createDataFrame([r for r in detections(random.Random(8), 50, dt.date(2019, 6, 1), 5) if r[7]], FIELDS)
    doc = runs.live(run, df, grid, places, past, [2018], "a table", "2019-06-05")
    assert doc["fires_table"] == "live_fires" and run.tables.table("live_fires").count() == doc["counts"]["fires"] > 10


def test_refresh_fetches_what_is_new(spark, tmp_path):
    """Only years beyond the recorded end are fetched; each product's year is replaced whole; the end is the last day that all cover."""
    pages, root = tmp_path / "pages", tmp_path / "run"
    pages.mkdir()
    head = "latitude,longitude,acq_date,acq_time,satellite,confidence,frp,daynight"

    # Pages begin every fifth day of each year asked for.
    def pages_of(product, days):
        for year in (2018, 2019):
            for k in range(0, 366, 5):
                s = dt.date(year, 1, 1) + dt.timedelta(days=k)
                hits = [d for d in days if s <= dt.date.fromisoformat(d) < s + dt.timedelta(days=5)]
                (pages / f"{product}-{s}").write_text("\n".join([head, *(f"10.5,50.5,{d},12,N,n,1.5,D" for d in hits for _ in range(2))]) + "\n")

    def available(a, b):
        (tmp_path / "availability.csv").write_text(f"data_id,min_date,max_date\nPA,2018-01-01,{a}\nPB,2018-01-01,{b}\nPC,2000-01-01,2001-01-01\n")

    products = {s: {"product": p, "url": f"file://{pages}/{p}-{{start}}"} for s, p in (("A", "PA"), ("B", "PB"))}
    run = runs.Run(spark, str(root))
    pages_of("PA", ["2018-03-01", "2019-01-03"])
    pages_of("PB", ["2018-05-01", "2018-12-31"])
    available("2019-01-10", "2019-01-04")
    assert runs.refresh(run, products, str(tmp_path / "availability.csv"), 2018) == "2019-01-04" == readers.last_day(spark, f"{root}/data_end.json", "-")
    archive = lambda: sorted((r.sensor, str(r.date)) for r in spark.read.parquet(f"{root}/archive").collect())
    assert archive() == [("A", "2018-03-01"), ("A", "2019-01-03"), ("B", "2018-05-01"), ("B", "2018-12-31")]
    old = {p.name for p in (root / "archive/sensor=A/year=2018").iterdir()}
    # 2018 was complete: what the service says of it now isn't asked for.
    pages_of("PA", ["2018-08-08", "2019-01-03", "2019-02-01"])
    pages_of("PB", ["2018-12-31", "2019-02-02"])
    available("2019-02-03", "2019-02-02")
    assert runs.refresh(run, products, str(tmp_path / "availability.csv"), 2018) == "2019-02-02"
    assert archive() == [("A", "2018-03-01"), ("A", "2019-01-03"), ("A", "2019-02-01"), ("B", "2018-05-01"), ("B", "2018-12-31"), ("B", "2019-02-02")]
    assert {p.name for p in (root / "archive/sensor=A/year=2018").iterdir()} == old
    with pytest.raises(LookupError):
        runs.refresh(run, {"A": {"product": "PX", "url": ""}}, str(tmp_path / "availability.csv"), 2018)
