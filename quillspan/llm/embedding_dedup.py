"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest reference points in order. Reference
points are random directions, so how much two such lists overlap depends only
on the angle between the vectors, not on how the data lie; a label has the more
of them the more vectors it has, so lists stay short. Inverted lists hold, for
each label and pivot, the vectors that have it among their nearest. Vectors of
a list that share enough pivots are candidates, counted in the list of the
smallest pivot they share alone. Counting needs no vectors: these are sent only
to the lists in which they have a candidate, and there verified by cosine.

Long lists fall into blocks, and pairs of blocks give each vector its number of
links and a spanning forest of the links found. Pairs are never written out.
Equal vectors are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, components, slices
from quillspan.llm.jaccard_join import forest_of, spanning

THRESHOLD = 0.98
#: The fewest and the most reference points of a label, and how long its lists should be on average.
PIVOTS, LIST_SIZE = (256, 65_536), 64
#: Vectors must share so many of their nearest pivots.
SHARED = 4
BLOCK = 1024
#: Pairs at the threshold that are drawn to choose how many nearest pivots describe a vector, and the most that may.
TRIALS, LONGEST = 4000, 64
#: Candidate pairs verified at a time.
PAIRS = 1 << 18


def pivots(dim: int, count: int) -> np.ndarray:
    """Random directions, the same for each call."""
    p = np.random.default_rng(97).normal(size=(count, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def nearest(unit: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest points of each row, nearest first; ties go to the smaller number."""
    out = np.empty((len(unit), k), np.int32)
    step = max(1, (1 << 22) // len(points))
    for at in range(0, len(unit), step):
        far = -np.round(unit[at : at + step] @ points.T, 12)
        if 4 * k < len(points):
            # All that are as near as the k-th, then in order of number.
            limit = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            for row, (values, last) in enumerate(zip(far, limit, strict=True)):
                some = np.flatnonzero(values <= last)
                out[at + row] = some[np.argsort(values[some], kind="stable")[:k]]
        else:
            out[at : at + step] = np.argsort(far, axis=1, kind="stable")[:, :k]
    return out


def list_length(dim: int, count: int, threshold: float = THRESHOLD, shared: int = SHARED) -> int:
    """How many nearest pivots to keep: the fewest at which every drawn pair at the threshold shares one more than needed."""
    if dim == 1:
        return min(count, shared + 1)
    rng, points, longest = np.random.default_rng(5), pivots(dim, count), min(count, LONGEST)
    x = rng.normal(size=(TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = nearest(x, points, longest), nearest(threshold * x + np.sqrt(1 - threshold**2) * u, points, longest)
    need = 0
    for one, two in zip(a, b, strict=True):
        place = np.full(count, longest)
        place[two] = np.arange(longest)
        # The pair shares shared + 1 pivots once the lists reach the (shared + 1)-th smallest of the larger ranks.
        need = max(need, int(np.sort(np.maximum(np.arange(longest), place[one]))[min(shared, longest - 1)]))
    return min(longest, need + 1)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _describe(lengths: dict[tuple[int, int], int]):
    def run(batches):
        points: dict[tuple[int, int], np.ndarray] = {}
        for batch in slices(batches, 5000):
            near: list = [None] * batch.num_rows
            kinds = np.stack([np.asarray(batch.column(c)) for c in ("dim", "count")], axis=1)
            for dim, count in np.unique(kinds, axis=0).tolist():
                at = np.flatnonzero((kinds == (dim, count)).all(axis=1))
                if (dim, count) not in points:
                    points[dim, count] = pivots(dim, count)
                unit = _units(batch.column("embedding").take(pa.array(at)), dim)
                for k, row in zip(at, nearest(unit, points[dim, count], lengths[dim, count]), strict=True):
                    near[k] = row
            yield pa.record_batch([*(batch.column(c) for c in batch.schema.names), pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return run


def _by_pivot(near: np.ndarray) -> dict[int, np.ndarray]:
    """Rows that have each pivot."""
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    values, begin = np.unique(flat[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order // near.shape[1], begin[1:]), strict=True))


def shared_enough(one: np.ndarray, two: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Matrix of pairs with at least `shared` common pivots of which `pivot`, which all rows have, is the smallest."""
    count, lower = np.zeros((len(one), len(two)), np.uint8), np.zeros((len(one), len(two)), bool)
    left = _by_pivot(one)
    right = left if one is two else _by_pivot(two)
    for q in left.keys() & right.keys():
        if left is right and len(left[q]) == 1:
            continue
        block = np.ix_(left[q], right[q])
        if q < pivot:
            lower[block] = True
        else:
            count[block] += 1
    return (count >= shared) & ~lower


def _near(table: pa.Table, rows: int) -> np.ndarray:
    return np.asarray(table.column("near").combine_chunks().flatten()).reshape(rows, -1)


def _candidates(table: pa.Table, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group, and which pairs of them share enough pivots."""
    i, j, pivot = (table.column(c)[0].as_py() for c in ("i", "j", "pivot"))
    block, near = np.asarray(table.column("block")), _near(table, table.num_rows)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    one = near[a]
    found = shared_enough(one, one if i == j else near[b], pivot, shared)
    if i == j:
        np.fill_diagonal(found, False)
    return a, b, found


def _screen(shared: int, columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        a, b, found = _candidates(table, shared)
        met = np.concatenate((a[found.any(axis=1)], b[found.any(axis=0)]))
        return table.take(pa.array(np.unique(met))).select(columns)

    return run


def _verify(threshold: float, shared: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, found = _candidates(table, shared)
        ids, mult = np.asarray(table.column("cls")), np.asarray(table.column("n_rows"))
        unit = _units(table.column("embedding").combine_chunks(), table.column("dim")[0].as_py())
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        number = np.zeros(len(ids), np.int64)
        if found.sum() * 8 > found.size:
            links = found & (unit[a] @ unit[b].T >= threshold)
            number[a] += links @ mult[b]
            if not same:
                number[b] += mult[a] @ links
            forest = forest_of(links, ids[a], ids[b])
        else:
            r, c = np.nonzero(found)
            true = np.concatenate([np.einsum("ij,ij->i", unit[a[r[k : k + PAIRS]]], unit[b[c[k : k + PAIRS]]]) >= threshold for k in range(0, len(r), PAIRS)] or [np.zeros(0, bool)])
            r, c = a[r[true]], b[c[true]]
            np.add.at(number, r, mult[c])
            if not same:
                np.add.at(number, c, mult[r])
            forest = spanning(ids[r], ids[c])
        some = np.flatnonzero(number)
        u = [*ids[some].tolist(), *(x for x, _ in forest)]
        v = [*[None] * len(some), *(y for _, y in forest)]
        n = [*number[some].tolist(), *[0] * len(forest)]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shared: int = SHARED, counts: tuple[int, int] = PIVOTS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    vectors: vec_id (integer), embedding (array of numbers), label; other
    columns are not read. Only vectors of one label and length are compared.
    counts: the fewest and the most pivots of a label. Null labels, null or
    zero vectors, and vectors with null or non-finite numbers link with
    nothing, nor do rows without vec_id; they are kept, each its own component.
    Repeated rows link with each other. Rows that share a vec_id with different
    vectors add up their links. An empty table stays empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    numbers = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(fine & numbers, F.lit(False)).alias("fine"))
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit("2"), "embedding", "label"))
    classes = rows.filter("fine").groupBy("h1", "h2").agg(F.min(F.col("vec_id").cast("long")).alias("cls"), F.count("*").alias("n_rows"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = scratch.table("classes", classes.withColumn("dim", F.size("embedding")))
    # Vectors are in about 10 lists each; a power of two, so that there are few numbers of pivots.
    wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.count("*") * 10 / LIST_SIZE)))
    labels = classes.groupBy("label", "dim").agg(F.greatest(F.lit(counts[0]), F.least(F.lit(counts[1]), wanted)).cast("int").alias("count"))
    labels = scratch.table("labels", labels)
    # One row for each length of vector and number of pivots; the driver draws a description length for each.
    lengths = {(r.dim, r["count"]): list_length(r.dim, r["count"], threshold, shared) for r in labels.select("dim", "count").distinct().collect()}
    described = classes.select("cls", "n_rows", "label", "dim", "embedding").join(labels, ["label", "dim"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in described.schema.fields)
    described = scratch.table("described", described.mapInArrow(_describe(lengths), f"{fields}, near array<int>"))
    key = ["label", "dim", "pivot"]
    listed = described.select("label", "dim", "cls", "near", F.explode("near").alias("pivot"))
    sizes = listed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    sizes = scratch.table("sizes", sizes)
    listed = listed.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    dealt = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "n_blocks")
    met = [*key, "i", "j", "block", "cls"]
    fields = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in met)
    met = scratch.table("met", dealt.groupBy(*key, "i", "j").applyInArrow(_screen(shared, met), fields))
    # Vectors go only to the lists in which they have a candidate.
    sent = met.join(described.select("cls", "n_rows", "embedding", "near"), "cls")
    found = sent.groupBy(*key, "i", "j").applyInArrow(_verify(threshold, shared), "u long, v long, links long")
    found = scratch.table("found", found)
    linked = found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("v is not null").select("u", "v"), scratch, "links").withColumnsRenamed({"node": "cls", "root": "component_id"})
    known = scratch.table("known", classes.select("h1", "h2", "cls", "n_rows").join(linked, "cls", "left").join(joined, "cls", "left"))
    scratch.drop("classes", "labels", "described", "sizes", "met", "found")
    # Rows that take no part have no class; two hashes of null never meet one.
    out = rows.select("vec_id", "fine", *(F.when(F.col("fine"), F.col(h)).alias(h) for h in ("h1", "h2"))).join(known, ["h1", "h2"], "left")
    component = F.when(F.col("fine"), F.coalesce("component_id", "cls")).otherwise(F.col("vec_id").cast("long"))
    return out.select(
        "vec_id",
        F.when(F.col("fine"), F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(u, v) AS (
  SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u
), low AS (
  SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n FROM pairs GROUP BY u
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, e.vec_id) AS component_id, e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.u LEFT JOIN low ON e.vec_id = low.u
"""
