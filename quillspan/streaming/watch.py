"""The watch over a folder that files of detections arrive in. Goes beyond the batch recomputation: keeps state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from quillspan.operators.grid import with_cells
from quillspan.operators.live import with_checks


def arrivals(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def daily_cells(stream: DataFrame, late: str = "2 days", step: float = 0.02) -> DataFrame:
    """Detections per day and cell, each detection once though files overlap. stream: id, ts, lat, lon."""
    fresh = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return with_cells(fresh, step).groupBy(F.window("ts", "1 day"), "ci", "cj").agg(F.count("*").alias("fires"))


def weekly_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Detections in sliding weeks."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("fires"))


#: What a cell keeps of a day, and what comes out: cells as they are now, and detections not seen before.
DAY_STATE = "seen array<bigint>, first string, first_id bigint, last string, last_id bigint, hills boolean, check boolean"
DAY_OUT = "kind string, day date, scope string, ci bigint, cj bigint, fires bigint, first string, first_id bigint, last string, last_id bigint, hills boolean, check boolean, lat double, lon double, hhmm string, frp double, level int"


def _keep_day(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One cell and day: new detections join those seen, and the cell comes out as it is now. The state goes when the day can't be in a window any more."""
    if state.hasTimedOut:
        state.remove()
        return
    day, scope, ci, cj = key
    seen, first, first_id, last, last_id, hills, check = state.get if state.exists else ([], None, None, None, None, False, False)
    known, fresh = set(seen), []
    for frame in frames:
        frame = frame[~frame["id"].isin(known)].drop_duplicates("id")
        known.update(frame["id"].tolist())
        fresh.append(frame)
    new = pd.concat(fresh)
    if state.exists and not len(new):
        return
    if scope == "outside":  # that the day came is all there is to know
        known = set()
    elif len(new):
        marks = list(zip(new["hhmm"], new["id"].astype(int), strict=True))
        (first, first_id), (last, last_id) = min([*marks, *([(first, first_id)] if first is not None else [])]), max([*marks, *([(last, last_id)] if last is not None else [])])
        hills, check = bool(new["hills"].iloc[0]), bool(new["check"].iloc[0])
    state.update((sorted(known), first, first_id, last, last_id, hills, check))
    state.setTimeoutTimestamp((pd.Timestamp(day) + pd.Timedelta(days=1)).value // 1_000_000)
    cell = {"kind": "cell", "day": day, "scope": scope, "ci": ci, "cj": cj, "fires": len(known), "first": first, "first_id": first_id, "last": last, "last_id": last_id, "hills": hills, "check": check, "lat": None, "lon": None, "hhmm": None, "frp": None, "level": None}
    yield pd.DataFrame([cell])
    if scope == "fire":
        for at in range(0, len(new), 10_000):
            part = new.iloc[at : at + 10_000]
            none = {c: None for c in ("first", "first_id", "last", "last_id")}
            yield pd.DataFrame({**cell, **none, "kind": "fire", "fires": 1, **{c: part[c].to_numpy() for c in ("hills", "check", "lat", "lon", "hhmm", "frp")}, "level": part["level"].to_numpy(np.int32)}, index=range(len(part)))


def cell_days(stream: DataFrame, static: DataFrame, grid: DataFrame, listed: DataFrame, days: int = 7) -> DataFrame:
    """The stateful watch: DAY_OUT rows for what a batch changes, and for nothing else.

    stream: id, ts, date, hhmm, lat, lon, frp, inside (of the region). Static
    tables meet each batch as they are then. The state is keyed by day and
    cell; it holds the ids of the day, so a detection that comes again counts
    once, and expires when the newest day that came is `days` later. What comes
    later than that is no longer in any window and is dropped. Rows outside the
    region only tell that their day came (scope "outside"); those on static
    sources are counted apart (scope "static").
    """
    late = stream.withWatermark("ts", f"{days} days")
    still = static.select("fi", "fj").distinct().withColumn("_still", F.lit(True))
    placed = with_checks(with_cells(late, 0.01, ("fi", "fj")).join(still, ["fi", "fj"], "left"), grid.select("ci", "cj", "slope_mean", "population"), listed)
    scope = F.when(~F.col("inside"), "outside").when(F.col("_still"), "static").otherwise("fire")
    nowhere = lambda c: F.when(F.col("inside"), F.col(c)).otherwise(0)
    keyed = placed.select("id", "ts", F.col("date").alias("day"), scope.alias("scope"), nowhere("ci").alias("ci"), nowhere("cj").alias("cj"), F.col("hhmm").cast("string").alias("hhmm"), "lat", "lon", "frp", "hills", "check", "level")
    return keyed.groupBy("day", "scope", "ci", "cj").applyInPandasWithState(_keep_day, DAY_OUT, DAY_STATE, "update", "EventTimeTimeout")


def run_available(frame: DataFrame, sink, checkpoint: str, mode: str = "append") -> list[dict]:
    """Work off all that has arrived; sink(batch, number) writes a batch, and may see it twice after a failure. Spark's progress of each batch comes back."""
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]
