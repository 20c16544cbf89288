"""Writers: tables, reports, compact map rows, refreshed years."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.staging import file_system


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def refresh_years(df: DataFrame, path: str) -> None:
    """Replace only the sensors and years that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sensor", "year").parquet(path)


def stale_years(known: dict[int, str], latest: str, years: list[int]) -> list[int]:
    """Years to fetch again: not complete up to their last day or the latest day on record."""
    return [y for y in years if known.get(y, "") < min(f"{y}-12-31", latest)]


def watermark(latest: dict[str, str]) -> str:
    """The last day that every product covers."""
    return min(latest.values())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON record a row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def as_arrays(df: DataFrame, places: int = 4) -> DataFrame:
    """One JSON array a row, numbers rounded: compact rows for a map."""
    cols = [F.bround(c, places) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    # Each value as the only field of an object, without the object's own signs: {"v": and }.
    texts = [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) for c in cols]
    values = F.transform(F.array(*texts), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))
    return df.select(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")).alias("json"))


def report(frames: dict[str, DataFrame], path: str | None = None, limit: int = 10_000) -> dict:
    """Small result tables as one document; tables beyond the limit belong in files of their own."""
    out = {}
    for name, df in frames.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has over {limit} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    if path:
        write_text(next(iter(frames.values())).sparkSession, path, json.dumps(out, indent=1, default=str))
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, on any file system Spark knows. Readers find the old text or the new one, never none: the new file takes the place of the old in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    (fs, at), (_, beside) = file_system(spark, path), file_system(spark, f"{path}.part")
    at, beside = fs.makeQualified(at), fs.makeQualified(beside)
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, at, over)


def read_report(spark: SparkSession, path: str) -> dict:
    """What report() wrote."""
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def save_model(model, path: str) -> None:
    """A fitted pipeline, in Spark's own format."""
    model.write().overwrite().save(path)
