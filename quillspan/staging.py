"""Tables written to the shared folder, which know what they were made from.

A stage reads files and other stages. Both are noted while it is made, the
files with their names, lengths and times of change, so that a later use sees
whether anything below it has changed, and makes anew exactly what lies above
the change.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="quillspan-")


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where it is unset, a temporary folder serves a local session; on a cluster that is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if context.master == "local" or context.master.startswith("local["):
        return _local_root()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder that goes with the session."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of the session: worked out once, and the same in all jobs that read it."""
    path = f"{scratch_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, at = file_system(spark, path)
        fs.delete(at, True)


def folder_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a column that the folders below path are named by, sorted; none without the path."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{column}="))


def numbered_folders(spark: SparkSession, path: str, column: str) -> list[int]:
    return sorted(map(int, folder_values(spark, path, column)))


#: Folders with more entries than this are listed by Spark's own tasks instead of one by one.
LISTED = 1000


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of all files below a path: names, lengths and times of change. Spark's own marks and hidden files don't count; "none" without a file."""
    digest, folders, found = hashlib.sha256(), [path], []
    while folders:
        fs, at = file_system(spark, folders.pop())
        if not fs.exists(at):
            continue
        listed = fs.listStatus(at)
        if len(listed) > LISTED:
            return _fingerprint_of_many(spark, path)
        for s in listed:
            name = s.getPath().toString()
            if s.isDirectory():
                folders.append(name)
            elif name.rpartition("/")[2][:1] not in "_.":
                found.append(f"{name}\0{s.getLen()}\0{s.getModificationTime()}\n")
    for line in sorted(found):
        digest.update(line.encode())
    return digest.hexdigest() if found else "none"


def _fingerprint_of_many(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    n, total, mark = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{n}-{total}-{mark}"


@dataclass
class Stage:
    """Where a table lies, its version, and the files and stages it was made from, as they were then."""

    path: str
    version: str
    files: dict[str, str] = field(default_factory=dict)
    stages: dict[str, str] = field(default_factory=dict)


class Stages:
    """Named tables under a folder, made at their first use and again when what they read has changed.

    With `manifest`, a file under the folder records them, so that later
    sessions use them too; else they last as long as this object.
    """

    def __init__(self, spark: SparkSession, root: str, manifest: bool = False):
        self.spark, self.root, self.manifest = spark, root, f"{root}/stages.json" if manifest else None
        self.known: dict[str, Stage] = {}
        self.open: list[Stage] = []
        if self.manifest and exists(spark, self.manifest):
            text = "\n".join(r.value for r in spark.read.text(self.manifest).collect())
            self.known = {name: Stage(**values) for name, values in json.loads(text).items()}

    def reads(self, path: str) -> None:
        """The stage that is being made reads this file or folder."""
        if self.open and path not in self.open[-1].files:
            self.open[-1].files[path] = fingerprint(self.spark, path)

    def fresh(self, name: str) -> bool:
        """Whether the stage is there, and all it was made from is as it was."""
        stage = self.known.get(name)
        if stage is None or not exists(self.spark, f"{stage.path}/_SUCCESS"):
            return False
        if any(fingerprint(self.spark, p) != was for p, was in stage.files.items()):
            return False
        return all(self.fresh(below) and self.known[below].version == was for below, was in stage.stages.items())

    def table(self, name: str, make: Callable[[], DataFrame], reads: tuple[str, ...] = ()) -> DataFrame:
        """The table as of now. reads: files and folders, besides those that make() notes by reads(); stages used inside make() are noted by themselves."""
        if not self.fresh(name):
            self._make(name, make, reads)
        stage = self.known[name]
        if self.open:
            self.open[-1].stages[name] = stage.version
        return self.spark.read.parquet(stage.path)

    def _make(self, name: str, make: Callable[[], DataFrame], reads: tuple[str, ...], attempts: int = 3) -> None:
        for _ in range(attempts):
            stage = Stage(f"{self.root}/{name}-{uuid.uuid4().hex[:12]}", uuid.uuid4().hex)
            self.open.append(stage)
            try:
                for path in reads:
                    self.reads(path)
                make().write.parquet(stage.path)
            finally:
                self.open.pop()
            if all(fingerprint(self.spark, p) == was for p, was in stage.files.items()):
                break
            drop_folders(self.spark, [stage.path])  # a file has changed while it was read
        else:
            raise RuntimeError(f"{name}: what it reads changes all the time")
        old = self.known.get(name)
        self.known[name] = stage
        if self.manifest:
            from quillspan.sources.writers import write_text

            write_text(self.spark, self.manifest, json.dumps({n: vars(s) for n, s in self.known.items()}, indent=1))
            if old:
                drop_folders(self.spark, [old.path])  # in a session's own folder frames made before may still read it


_SESSIONS: dict[str, Stages] = {}


def session_stages(spark: SparkSession) -> Stages:
    """Stages that last as long as the application."""
    key = spark.sparkContext.applicationId
    if key not in _SESSIONS:
        _SESSIONS[key] = Stages(spark, scratch_folder(spark, "stages"))
    return _SESSIONS[key]


def staged(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` made from files under `source` (which make() reads by reading()), written at its first use in a session and read while they stay as they are."""
    return session_stages(spark).table(f"{hashlib.sha256(source.encode()).hexdigest()[:12]}-{name}", make)


def reading(spark: SparkSession, path: str) -> str:
    """path, noted for the stage that is being made, if one is."""
    session_stages(spark).reads(path)
    return path
