"""Shared pieces of the text operators: written tables, word hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.staging import file_system, scratch_folder

#: Words everywhere in this subpackage: runs without these six ASCII characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Rows and bytes of an Arrow batch that a task works on at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and about so many bytes, whatever the session's batch size is. At least one batch for each that comes in."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for k in range(0, max(1, batch.num_rows), step):
            yield batch.slice(k, step)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front until no column of df is called so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    table() cuts the lineage of a frame; drop() deletes a table that later
    steps no longer read. What a returned frame still reads stays until the
    session ends, and goes then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_folder(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str, collect: bool = True) -> None:
        """Delete tables; with collect, let the driver forget the shuffles behind them too, so that their files go."""
        for name in names:
            fs, path = file_system(self.spark, self.path(name))
            fs.delete(path, True)
        if collect:
            self.spark.sparkContext._jvm.System.gc()


class WordHashes(dict):
    """64-bit hashes of words, remembered for at most `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of any run of words in O(1), from prefix sums of word hashes modulo 2^64."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def load(self, hashes: np.ndarray) -> "SpanHash":
        n = len(hashes) + 1
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, np.uint64(factor), dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(hashes * self.up[: n - 1], out=self.sums[1:])
        return self

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words first..last-1."""
        raw = (self.sums[last] - self.sums[first]) * self.down[first]
        return mix64(raw + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Only doc_id, text and a key of the row's content: rows that agree in both get equal results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


#: Parts that the neighbours of one node are dealt to.
SALTS = 8


def _beside_lowest(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Rows (u, v) with m of their u. A hub's rows go to several tasks, and adaptive execution can split these further."""
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): one row (node, root), root the smallest node.

    Alternates large-star and small-star steps, which end in stars around the
    smallest nodes after a few rounds. Every round is a written table; only a
    count and a checksum come to the driver. Nodes without an edge have no row.
    """
    step = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    step = scratch.table(f"{name}0", step)
    seen = None
    for i in range(1, max_rounds + 1):
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _beside_lowest(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _beside_lowest(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        step = scratch.table(f"{name}{i}", small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = step.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        scratch.drop(f"{name}{i - 1}", collect=False)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not stable after {max_rounds} rounds")
    roots = step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return step.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
