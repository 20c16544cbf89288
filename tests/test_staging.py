"""Stages are made again when, and only when, something below them has changed."""

import os
import time

import pytest

from quillspan import runs
from quillspan.plans import registry
from quillspan.sources.writers import write_text
from quillspan.staging import Stages, fingerprint, scratch_folder


def write(spark, path, values, mode="overwrite"):
    spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.mode(mode).parquet(path)


def test_exactly_the_stages_below_a_change_are_made_again(spark, tmp_path):
    a, b, made = str(tmp_path / "a"), str(tmp_path / "b"), []
    write(spark, a, [1, 2])
    write(spark, b, [10])
    stages = Stages(spark, str(tmp_path / "stages"), manifest=True)

    def stage(name, make):
        return stages.table(name, lambda: (made.append(name), make())[1])

    def read(path):
        stages.reads(path)
        return spark.read.parquet(path)

    left = lambda: stage("left", lambda: read(a))
    right = lambda: stage("right", lambda: read(b))
    both = lambda: stage("both", lambda: left().unionByName(right()))
    top = lambda: sorted(r.v for r in stage("top", both).collect())
    assert top() == [1, 2, 10] and sorted(made) == ["both", "left", "right", "top"]
    made.clear()
    assert top() == [1, 2, 10] and made == []
    write(spark, b, [11], "append")  # a file is added
    assert top() == [1, 2, 10, 11] and sorted(made) == ["both", "right", "top"]
    made.clear()
    file = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part"))
    os.utime(file, (time.time(), os.stat(file).st_mtime + 5))  # changed in place, of equal length
    assert top() == [1, 2, 10, 11] and sorted(made) == ["both", "left", "top"]
    made.clear()
    stages = Stages(spark, str(tmp_path / "stages"), manifest=True)  # another session
    assert top() == [1, 2, 10, 11] and made == []
    # A stage made again for a use of its own renews those above it when they are used.
    write(spark, a, [5])
    assert sorted(r.v for r in left().collect()) == [5] and made == ["left"]
    assert top() == [5, 10, 11] and made == ["left", "top", "both"]


def test_files_that_change_while_they_are_read(spark, tmp_path):
    a = str(tmp_path / "a")
    write(spark, a, [1])
    stages, calls = Stages(spark, str(tmp_path / "stages")), []

    def make():
        stages.reads(a)
        calls.append(1)
        df = spark.read.parquet(a)
        if len(calls) < 2:
            write(spark, f"{a}/more", [len(calls)])
        return df

    stages.table("t", make)
    assert len(calls) == 2
    with pytest.raises(RuntimeError):
        stages.table("never", lambda: (stages.reads(a), write(spark, f"{a}/{time.time()}", [1]), spark.range(1))[-1])
    assert fingerprint(spark, str(tmp_path / "nothing")) == "none"


@pytest.mark.parametrize("name", ["monthly_counts", "season_table"])
def test_queries_follow_their_tables(spark, tmp_path, name):
    """The fault of the round before: half of the line items removed under the same path gave the old answer."""
    sf = "/root/testdata/sf0.001"
    for t in ("supplier", "nation", "part"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    ask = lambda: sorted(map(str, registry.queries()[name](spark, str(tmp_path)).collect()))
    first = ask()
    assert ask() == first
    lines.filter("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert ask() != first
    lines.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert ask() == first


def test_folders_of_many_files(spark, tmp_path, monkeypatch):
    a = str(tmp_path / "a")
    spark.range(12).selectExpr("id", "id as v").repartition(6).write.partitionBy("id").parquet(a)
    few, marks = fingerprint(spark, a), set()
    monkeypatch.setattr("quillspan.staging.LISTED", 3)
    for k in range(3):
        marks.add(fingerprint(spark, a))
        assert fingerprint(spark, a) in marks and fingerprint(spark, a) != few
        write(spark, f"{a}/id={50 + k}", [k])
    assert len(marks) == 3


def test_kept_rasters_and_whole_texts(spark, tmp_path):
    run, tiles = runs.Run(spark, str(tmp_path / "run")), str(tmp_path / "tiles")
    df = spark.createDataFrame([(0, 0, r, c, float(r * c)) for r in range(4) for c in range(4)], "tx int, ty int, r int, c int, value double")
    df.write.parquet(tiles)
    raster = lambda: runs.slope_raster(run, spark.read.parquet(tiles), 9, 0, 0, (tiles,))
    first = raster().inputFiles()
    assert raster().inputFiles() == first and len(raster().collect()) == 16
    df.withColumn("value", df.value + 1).write.mode("append").parquet(tiles)
    assert raster().inputFiles() != first
    path = f"{scratch_folder(spark, 'text')}/a.txt"
    for text in ("one", "two"):
        write_text(spark, path, text)
        assert open(path.removeprefix("file:")).read() == text and not os.path.exists(f"{path}.part")
