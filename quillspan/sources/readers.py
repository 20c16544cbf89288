"""Readers of archives, polygons, settlements, live files and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspan.operators.live import decode_confidence
from quillspan.operators.spatial import read_window, tag_polygons

COMMON = "scan double, track double, acq_date string, acq_time string, satellite string"
ARCHIVE_A = f"latitude double, longitude double, brightness double, {COMMON}, instrument string, confidence string, version string, bright_t31 double, frp double, daynight string, type int"
ARCHIVE_B = f"latitude double, longitude double, bright_ti4 double, {COMMON}, instrument string, confidence string, version string, bright_ti5 double, frp double, daynight string, type int"
LIVE = f"latitude double, longitude double, bright_ti4 double, {COMMON}, confidence string, version string, bright_ti5 double, frp double, daynight string"
GEOJSON = "type string, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
OSM = "elements array<struct<type: string, id: bigint, lat: double, lon: double, tags: map<string,string>>>"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist and are not empty, on any file system Spark reads."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and (fs.getFileStatus(path).isDirectory() or fs.getFileStatus(path).getLen() > 0):
            found.append(p)
    return found


def read_archive(spark: SparkSession, families: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Yearly CSV files of several record families as one table; sensor names the family. Missing and empty files are skipped."""
    out = None
    for sensor, (paths, schema) in families.items():
        found = existing(spark, paths)
        if found:
            part = spark.read.schema(schema).option("header", True).csv(found).withColumn("sensor", F.lit(sensor))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no archive file with content")
    return out


def normalise(raw: DataFrame) -> DataFrame:
    """Detections: sensor, satellite, date, hhmm, year, month, lat, lon, frp, conf, daynight, kind."""
    date = F.to_date("acq_date")
    return raw.select(
        "sensor", F.when(F.col("satellite") == "N", "S-NPP").otherwise(F.col("satellite")).alias("satellite"), date.alias("date"),
        F.col("acq_time").try_cast("int").alias("hhmm"), F.year(date).alias("year"), F.month(date).alias("month"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "frp", decode_confidence(F.col("confidence")).alias("conf"),
        "daynight", F.coalesce(F.col("type"), F.lit(0)).alias("kind"))


def read_polygons(spark: SparkSession, path: str, name: str = "shapeName") -> DataFrame:
    """name and rings (arrays of (x, y)) of a GeoJSON file's polygons; parts of a multi-polygon add their rings."""
    feature = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    return feature.select(F.element_at("f.properties", name).alias("name"), F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one).alias("rings"))


def read_settlements(spark: SparkSession, path: str) -> DataFrame:
    """place_id, name, place, lat, lon of map elements; an English name first, empty ones count as missing."""
    e = spark.read.schema(OSM).option("multiLine", True).json(path).select(F.posexplode("elements").alias("place_id", "e"))
    tag = lambda k: F.nullif(F.element_at("e.tags", k), F.lit(""))
    return e.select("place_id", F.coalesce(tag("name:en"), tag("name"), F.lit("(unnamed)")).alias("name"), tag("place").alias("place"), "e.lat", "e.lon")


def read_live(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> tuple[DataFrame, str | None]:
    """Live detections inside the box (west, south, east, north), times padded to four digits, and the last date of the whole file. A file without the header, such as an error page, is an error."""
    first = spark.read.text(path).first()
    if first is None or not first.value.startswith("latitude"):
        raise ValueError(f"not a table of detections: {(first.value if first else '')[:80]!r}")
    raw = spark.read.schema(LIVE).option("header", True).csv(path)
    last = raw.agg(F.max("acq_date")).first()[0]
    west, south, east, north = box
    inside = raw.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return inside.withColumn("acq_time", F.lpad("acq_time", 4, "0")), last


def raster_position(points: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """Row and column of each point (lat, lon) in a raster whose first pixel begins at (lat0, lon0), rows going south."""
    return points.withColumn("row", F.floor((lat0 - F.col("lat")) / step).cast("long")).withColumn("col", F.floor((F.col("lon") - lon0) / step).cast("long"))


class _Slice(InputPartition):
    def __init__(self, start: str, days: int):
        self.start, self.days = start, days


class PagedDetections(DataSource):
    """Detections from a paged service, a few days to a request, one partition a request.

    Options: url (with {start} and {days}; {key} if a key is needed), start, end
    (days), page (days a request, 5 by default), key. A page without the CSV
    header is an error, a page without rows is empty. Values are strings.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_detections"

    def schema(self) -> str:
        return "latitude string, longitude string, acq_date string, acq_time string, satellite string, confidence string, frp string, daynight string"

    def reader(self, schema):
        return _PagedReader(self.options, [f.name for f in schema.fields])


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self):
        from datetime import date, timedelta

        start, end = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        page = int(self.options.get("page", 5))
        return [_Slice(str(start + timedelta(days=d)), min(page, (end - start).days + 1 - d)) for d in range(0, (end - start).days + 1, page)]

    def read(self, partition):
        """Arrow batches of the page, whose columns may come in any order."""
        import io
        from urllib.request import urlopen

        import pyarrow as pa
        from pyarrow import csv

        url = self.options["url"].format(start=partition.start, days=partition.days, key=self.options.get("key", ""))
        with urlopen(url, timeout=120) as answer:  # noqa: S310
            page = answer.read()
        if not page.startswith(b"latitude"):
            raise ValueError(f"not a table of detections for {partition.start}: {page[:80]!r}")
        convert = csv.ConvertOptions(include_columns=self.columns, include_missing_columns=True, column_types={c: pa.string() for c in self.columns}, strings_can_be_null=False)
        yield from csv.read_csv(io.BytesIO(page), convert_options=convert).to_batches()


def access_key(name: str, env_file: str = ".env") -> str:
    """A key from the environment, else from a line name=value of a file; LookupError without either. It is never logged."""
    import os

    if os.environ.get(name):
        return os.environ[name]
    if os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                left, sign, right = line.partition("=")
                if sign and left.strip() == name and right.strip():
                    return right.strip().strip("\"'")
    raise LookupError(f"no {name} in the environment or in {env_file}")


def fetch_days(spark: SparkSession, start: str, end: str, edges: DataFrame | None = None, **options: str) -> DataFrame:
    """All days from the paged service once each, clipped to the days asked for and, with edges (see spatial.edges_of), to their polygons."""
    spark.dataSource.register(PagedDetections)
    read = spark.read.format(PagedDetections.name()).options(start=start, end=end, **options).load()
    days = read.dropDuplicates().filter(F.col("acq_date").between(start, end))
    if edges is None:
        return days
    spots = days.select("latitude", "longitude", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")).distinct()
    inside = tag_polygons(spots, edges, ["latitude", "longitude"]).filter("poly_id is not null")
    return days.join(inside.select("latitude", "longitude"), ["latitude", "longitude"], "left_semi")


def read_availability(spark: SparkSession, path: str) -> DataFrame:
    """product and last day of a table of data_id, min_date, max_date; a product listed twice has its latest day."""
    raw = spark.read.schema("data_id string, min_date string, max_date string").option("header", True).csv(path)
    return raw.groupBy(F.col("data_id").alias("product")).agg(F.max("max_date").alias("last_day"))


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, row, col, lat, lon, value) of GeoTIFF files with one band: middles of pixels, negative values as 0. Several files give several rasters."""
    from quillspan.sources.geotiff import pixels

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(pixels, "path string, row long, col long, lat double, lon double, value double")


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, level: int = 0, blocks: int = 64) -> DataFrame:
    """Pixels (path, row, col, lat, lon, value) of one GeoTIFF file, of which only the blocks are read that the rows and columns (first and last) touch. level 1 and up are overviews. In sessions with spark.sql.python.filterPushdown.enabled, filters on row, col, lat and lon do the same."""
    from quillspan.sources.geotiff import RasterWindow

    spark.dataSource.register(RasterWindow)
    read = spark.read.format(RasterWindow.name()).options(path=path, level=level, blocks=blocks, filters=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, span in (("row", rows), ("col", cols)):
        if span is not None:
            read = read.options(**{f"{name}_min": span[0], f"{name}_max": span[1]})
    return read.load()


def read_raster_window(spark: SparkSession, path: str, row0: int, col0: int, height: int, width: int, level: int = 0) -> DataFrame:
    """Pixels (row, col, value) of a window of a GeoTIFF file, counted from its corner; those off the image are 0."""
    part = read_raster(spark, path, (row0, row0 + height - 1), (col0, col0 + width - 1), level)
    return read_window(part, row0, col0, height, width)


def last_day(spark: SparkSession, path: str, otherwise: str) -> str:
    """The last day that a JSON file {"data_end": day} records; otherwise without the file."""
    if not existing(spark, [path]):
        return otherwise
    return spark.read.schema("data_end string").option("multiLine", True).json(path).first().data_end or otherwise
