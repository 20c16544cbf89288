"""Near-duplicate documents by Jaccard similarity of word n-grams, through a MinHash LSH forest.

A document has a signature of `depth` minima for each tree of the forest. The
signatures of a tree form a prefix trie, and documents that share a node at
depth d are candidates; at similarity s they share one in some tree with
probability 1 - (1 - s^d)^trees. Matching begins at the whole signatures and
shortens prefixes level by level. Links found tell by their similarities how
many more there must be (each counts 1 / its probability); shortening ends once
that estimate meets the target recall, and at the latest at the depth where a
pair just at the threshold is found with it.

A pair belongs to the longest prefix that it shares. Nodes that share documents
make up groups. A group is compared as a whole where that is less work, else
node by node: a pair then belongs to the first tree in which it shares the
prefix, and n-gram sets go only to nodes where a document has such a pair. Pairs
are verified exactly. Long nodes and groups fall into blocks. Documents with equal n-gram sets are one class
from the start. Neither classes nor nodes are ever written out as pairs: a
block gives each class its number of links, and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import Scratch, SpanHash, WordHashes, as_long, components, documents, free_name, mix64, slices, with_row_key

NGRAM = 5
THRESHOLD = 0.8
TREES = 40
DEPTH = 8
RECALL = 0.9999
#: Classes of a node that one block holds, and n-grams.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Columns of an indicator matrix held at a time.
COLUMNS = 8192
#: Similarities of links are counted in so many equal parts from the threshold to 1.
PARTS = 20
#: What comparing one pair of sets costs, in multiplications of a matrix product.
PAIR_COST = 400_000


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair shares a node at this depth."""
    return 1 - (1 - similarity**depth) ** trees


def levels(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """Prefix lengths from the whole signature down to the one that finds a pair at the threshold with the target recall."""
    for d in range(depth, 0, -1):
        if found_share(threshold, d, trees) >= recall:
            return list(range(depth, d - 1, -1))
    raise ValueError(f"{trees} trees can't find pairs of similarity {threshold} with recall {recall}; take more trees")


def estimated_recall(histogram: dict[int, int], depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Links found over links that must be there, from the similarities of those found; 0 without any, as they tell nothing."""
    width = (1 - threshold) / PARTS
    there = sum(n / found_share(threshold + k * width, depth, trees) for k, n in histogram.items())
    return sum(histogram.values()) / there if there else 0.0


class Shingles:
    """Distinct hashed word n-grams of texts; a text under n words is one shorter n-gram, an empty one has none."""

    def __init__(self, n: int):
        self.n, self.cache, self.hash = n, WordHashes(), SpanHash(0x9E3779B97F4A7C15)

    def of(self, text: bytes | None) -> np.ndarray:
        words = self.cache.of((text or b"").split())
        if not len(words):
            return words
        self.hash.load(words)
        first = np.arange(max(1, len(words) - self.n + 1))
        return np.unique(self.hash.spans(first, np.minimum(first + self.n, len(words))))


def _signatures(n: int, trees: int, depth: int, lengths: list[int]):
    """Per text: two hashes of its n-gram set, how many it has, and for each prefix length the hashes of its prefixes, tree by tree."""
    names = [f"p{d}" for d in lengths]
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n_shingles", pa.int32()), *((c, pa.list_(pa.int64())) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        rng = np.random.default_rng(20240229)
        factor = (rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        plus = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)[:, None]
        spread = mix64(np.arange(1, depth + 1, dtype=np.uint64))
        for batch in slices(batches):
            s1, s2, size, prefixes = [], [], [], {d: [] for d in lengths}
            for text in batch.column("text").to_pylist():
                grams = shingles.of(text)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                size.append(len(grams))
                if not len(grams):
                    for d in lengths:
                        prefixes[d].append(None)
                    continue
                short = (grams >> np.uint64(32)).astype(np.uint32)
                low = np.full(len(factor), 0xFFFFFFFF, dtype=np.uint32)
                for k in range(0, len(short), 128):
                    x = factor * short[None, k : k + 128] + plus
                    x ^= x >> np.uint32(15)
                    np.minimum(low, (x * np.uint32(0x2C1B3C6D)).min(axis=1), out=low)
                parts = np.cumsum(mix64(low.reshape(trees, depth).astype(np.uint64) + spread) * spread, axis=1, dtype=np.uint64)
                for d in lengths:
                    prefixes[d].append(as_long(mix64(parts[:, d - 1])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int32()), *(pa.array(prefixes[d], pa.list_(pa.int64())) for d in lengths)], schema=schema)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in slices(batches):
            grams = [shingles.of(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("cls"), batch.column("n_rows"), pa.array(grams, pa.binary())], names=["cls", "n_rows", "grams"])

    return run


def _common(one: list[np.ndarray], two: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Matrix of how many n-grams are in both; only where pairs is true need it be right."""
    if not pairs.any():
        return np.zeros(pairs.shape)
    size1, size2 = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    if pairs.sum() * PAIR_COST < len(one) * size2.sum() + size1.sum() * len(two):
        common = np.zeros(pairs.shape, dtype=np.float64)
        for r, c in zip(*np.nonzero(pairs), strict=True):
            small, large = (one[r], two[c]) if size1[r] <= size2[c] else (two[c], one[r])
            at = np.searchsorted(large, small)
            common[r, c] = (large[np.minimum(at, len(large) - 1)] == small).sum()
        return common
    common = np.zeros((len(one), len(two)), dtype=np.float32)
    u1, c1 = np.unique(np.concatenate(one), return_counts=True)
    vocabulary = np.intersect1d(u1, np.unique(np.concatenate(two)), assume_unique=True)
    if one is two:
        vocabulary = u1[c1 > 1]
    place = [np.searchsorted(vocabulary, x) for x in one], [np.searchsorted(vocabulary, x) for x in two]
    rows = []
    for sets, at in zip((one, two), place, strict=True):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at, value = np.concatenate(at), np.concatenate(sets)
        hit = at < len(vocabulary)
        hit[hit] = vocabulary[at[hit]] == value[hit]
        rows.append((owner[hit], at[hit]))
    for k in range(0, len(vocabulary), COLUMNS):
        part = []
        for (owner, at), n in zip(rows, (len(one), len(two)), strict=True):
            m = np.zeros((n, min(COLUMNS, len(vocabulary) - k)), dtype=np.float32)
            inside = (at >= k) & (at < k + COLUMNS)
            m[owner[inside], at[inside] - k] = 1
            part.append(m)
        common += part[0] @ part[1].T
    return common.astype(np.float64)


def spanning(rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (rows[i], columns[i])."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(rows.tolist(), columns.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def forest_of(links: np.ndarray, ids1: np.ndarray, ids2: np.ndarray) -> list[tuple[int, int]]:
    """As spanning(), but of a whole matrix: rows join their first link, then first links of columns."""
    if not links.any():
        return []
    first = links.argmax(axis=1)
    has = links.any(axis=1)
    rows = np.flatnonzero(has)
    edges = set(zip(ids1[rows].tolist(), ids2[first[rows]].tolist(), strict=True))
    # Rows with equal first links are joined already; other links are needed only between different stars.
    star = np.where(has, first, -1)
    mixed = links & (star[:, None] != np.arange(links.shape[1])[None, :])
    r, c = np.nonzero(mixed)
    key = np.unique(star[r].astype(np.int64) * links.shape[1] + c, return_index=True)[1] if len(r) else []
    edges.update(zip(ids1[r[key]].tolist(), ids2[c[key]].tolist(), strict=True) if len(r) else ())
    a, b = np.array([e for e in edges], dtype=np.int64).reshape(-1, 2).T
    return spanning(a, b)


def _keys(table: pa.Table, column: str, rows: np.ndarray) -> np.ndarray:
    return np.asarray(table.column(column).combine_chunks().flatten()).reshape(table.num_rows, -1)[rows]


def _candidates(table: pa.Table, longer: bool, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group, and which pairs of them are compared here.

    None that has a longer prefix in common. In a node, those that have no
    prefix of this length in common in an earlier tree; in a whole group, those
    that have one in any tree.
    """
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    block = np.asarray(table.column("block"))
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    one, two = _keys(table, "now", a), _keys(table, "now", b)
    last = one.shape[1] if whole else table.column("tree")[0].as_py()
    met = np.zeros((len(a), len(b)), bool)
    for t in range(last):
        met |= one[:, t][:, None] == two[:, t][None, :]
    found = met if whole else ~met
    if longer:
        one, two = _keys(table, "before", a), _keys(table, "before", b)
        for t in range(one.shape[1]):
            found &= one[:, t][:, None] != two[:, t][None, :]
    if i == j:
        np.fill_diagonal(found, False)
    return a, b, found


def _screen(longer: bool):
    columns = ["tree", "node", "i", "j", "block", "cls"]

    def run(table: pa.Table) -> pa.Table:
        a, b, found = _candidates(table, longer, False)
        met = np.unique(np.concatenate((a[found.any(axis=1)], b[found.any(axis=0)])))
        return table.take(pa.array(met)).select(columns)

    return run


def _verify(threshold: float, longer: bool, whole: bool):
    """Rows (kind, u, v, n): 0: class u has n links here; 1: an edge of the spanning forest; 2: n links in part u of the similarities."""
    schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, found = _candidates(table, longer, whole)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if same:
            found = np.triu(found)
        ids, mult = np.asarray(table.column("cls")), np.asarray(table.column("n_rows"))
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        one = [sets[k] for k in a]
        two = one if same else [sets[k] for k in b]
        both = _common(one, two, found)
        union = np.array([len(x) for x in one], float)[:, None] + np.array([len(x) for x in two], float)[None, :] - both
        # both >= threshold * union, with room for rounding of the product alone
        links = found & (both >= threshold * union - 1e-9)
        r, c = np.nonzero(links)
        number = np.zeros(len(ids), np.int64)
        np.add.at(number, a[r], mult[b[c]])
        np.add.at(number, b[c], mult[a[r]])
        some = np.flatnonzero(number)
        part = np.minimum(((both[r, c] / union[r, c] - threshold) * PARTS / max(1 - threshold, 1e-9)).astype(int), PARTS - 1)
        bars, size = np.unique(np.maximum(part, 0), return_counts=True)
        forest = forest_of(links, ids[a], ids[b])
        kinds = [0] * len(some) + [1] * len(forest) + [2] * len(bars)
        u = [*ids[some].tolist(), *(x for x, _ in forest), *bars.tolist()]
        v = [*[None] * len(some), *(y for _, y in forest), *[None] * len(bars)]
        n = [*number[some].tolist(), *[None] * len(forest), *size.tolist()]
        return pa.table([pa.array(kinds, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """members (cls, n_blocks) in pairs of blocks i, j, each with its own block."""
    members = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "n_blocks")


def _level(classes: DataFrame, raw: DataFrame, scratch: Scratch, d: int, longer: int | None, n: int, threshold: float) -> DataFrame:
    """Verified links of pairs whose longest common prefix has d minima, as rows of _verify().

    Nodes that share documents make up a group. A group is compared as a whole
    where that sends fewer rows than its nodes one by one would: close copies
    share most trees. Groups that chance prefixes chain together are compared
    node by node.
    """
    keys = [F.col(f"p{d}").alias("now"), *([F.col(f"p{longer}").alias("before")] if longer else [])]
    leaves = classes.select("cls", "n_shingles", F.posexplode(f"p{d}").alias("tree", "node"))
    # Sums of halves of a hash tell sets of classes apart: nodes of several trees with the same classes are one.
    h = F.xxhash64("cls")
    nodes = leaves.groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("grams"), F.min("cls").alias("top"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))
    nodes = nodes.filter("n > 1").groupBy("n", "grams", "top", "low", "high").agg(F.min(F.struct("tree", "node")).alias("first"))
    blocks = lambda n, grams: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(grams) / BLOCK_SHINGLES)).cast("int")
    nodes = scratch.table(f"nodes{d}", nodes.select("first.*", "n", "top", blocks("n", "grams").alias("n_blocks")))
    members = leaves.join(nodes, ["tree", "node"])
    stars = members.filter("cls != top").select(F.col("cls").alias("u"), F.col("top").alias("v"))
    groups = components(stars, scratch, f"groups{d}_").withColumnsRenamed({"node": "cls"})
    groups = groups.join(classes.select("cls", "cls_key", "n_rows", "n_shingles", *keys), "cls")
    groups = scratch.table(f"groups{d}", groups)
    alone = nodes.join(groups.select("cls", "root"), nodes.top == groups.cls).groupBy("root").agg(F.sum(F.col("n") * F.col("n_blocks")).alias("sent"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("classes"), F.sum("n_shingles").alias("grams")).withColumn("n_blocks", blocks("classes", "grams"))
    sizes = scratch.table(f"sizes{d}", sizes.join(alone, "root").select("root", "n_blocks", (F.col("classes") * F.col("n_blocks") <= F.col("sent")).alias("whole")))
    placed = groups.join(sizes, "root")
    again = ["now", "before"][: len(keys)]
    chosen, node = placed.filter("whole").select("cls", "cls_key", "n_rows"), ["tree", "node", "i", "j"]
    split = not sizes.filter("not whole").isEmpty()
    if split:
        parts = placed.filter("not whole").select("cls", "cls_key", "n_rows", *again)
        members = _dealt(members.select("cls", "tree", "node", "n_blocks").join(parts.drop("cls_key", "n_rows"), "cls"))
        met = members.groupBy(*node).applyInArrow(_screen(longer is not None), "tree int, node long, i int, j int, block int, cls long")
        met = scratch.table(f"met{d}", met)
        chosen = chosen.unionByName(parts.drop(*again).join(met.select("cls").distinct(), "cls", "left_semi"))
    chosen = scratch.table(f"chosen{d}", chosen)
    # Texts are dealt by document whatever the size, as with any larger table; a sort-merge join can spill.
    texts = raw.join(chosen.hint("merge"), (raw.doc_id == chosen.cls) & (raw.row_key == chosen.cls_key))
    # One text for each class, though its document may be repeated.
    sets = texts.groupBy("cls", "n_rows").agg(F.max("text").alias("text")).mapInArrow(_sets(n), "cls long, n_rows long, grams binary")
    ready = scratch.table(f"sets{d}", sets).join(placed.select("cls", "root", "n_blocks", "whole", *again), "cls")
    kinds = "kind int, u long, v long, n long"
    found = _dealt(ready.filter("whole").drop("whole")).groupBy("root", "i", "j").applyInArrow(_verify(threshold, longer is not None, True), kinds)
    if split:
        one_by_one = met.join(ready.drop("root", "n_blocks", "whole"), "cls")
        found = found.unionByName(one_by_one.groupBy(*node).applyInArrow(_verify(threshold, longer is not None, False), kinds))
    found = scratch.table(f"found{d}", found)
    scratch.drop(*(f"{name}{d}" for name in ("nodes", "groups", "sizes", "met", "chosen", "sets")))
    return found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, copy_id, n_shingles.

    docs: doc_id (integer) and text; other columns are not read. class_id is
    the smallest doc_id reachable by links; n_links counts the other rows at or
    above the threshold, copies included; copy_id is the smallest doc_id with
    the same n-gram set. Texts without a word (null ones too) have equal sets,
    so they are copies and link with nothing else; rows without an id link with
    nothing and have no class. Rows that repeat are copies; rows that share an
    id but no text add up their links. An empty table stays empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    raw = with_row_key(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), "row_key")
    lengths = levels(threshold, trees, depth, recall)
    fields = ", ".join(f"p{d} array<long>" for d in lengths)
    signed = scratch.table("signed", raw.mapInArrow(_signatures(n, trees, depth, lengths), f"doc_id long, row_key long, s1 long, s2 long, n_shingles int, {fields}"))
    real = signed.filter("doc_id is not null")
    classes = real.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "row_key")).alias("one"), F.count("*").alias("n_rows"), *(F.first(f"p{d}").alias(f"p{d}") for d in lengths))
    classes = scratch.table("classes", classes.select("s1", "s2", "n_shingles", F.col("one.doc_id").alias("cls"), F.col("one.row_key").alias("cls_key"), "n_rows", *(f"p{d}" for d in lengths)))
    ids = scratch.table("ids", signed.select("doc_id", "s1", "s2", "n_shingles"))
    scratch.drop("signed")

    found, histogram, longer = None, {}, None
    for d in lengths:
        level = _level(classes, raw, scratch, d, longer, n, threshold)
        found = level if found is None else found.unionByName(level)
        # One row for each of PARTS similarities.
        for r in level.filter("kind = 2").groupBy("u").agg(F.sum("n").alias("n")).collect():
            histogram[r.u] = histogram.get(r.u, 0) + r.n
        if estimated_recall(histogram, d, threshold, trees) >= recall:
            break
        longer = d
    linked = found.filter("kind = 0").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("links"))
    joined = components(found.filter("kind = 1").select("u", "v"), scratch, "links").withColumnsRenamed({"node": "cls", "root": "component_id"})
    known = scratch.table("known", classes.select("s1", "s2", "cls", "n_rows").join(linked, "cls", "left").join(joined, "cls", "left"))
    scratch.drop("classes", *(f"found{d}" for d in lengths))
    out = ids.join(known, ["s1", "s2"], "left")
    real = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(real, F.coalesce("component_id", "cls")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(real, F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(real, F.col("cls")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """docs with one row of each class of near_duplicates(): that of the smallest doc_id.

    Rows that share a doc_id are one document, of which the longest text stays.
    Of texts without a word one stays, and rows without a doc_id all do.
    """
    doc, root, rows, at = (free_name(docs, f"near_{c}") for c in ("doc", "root", "rows", "place"))
    kept = near_duplicates(docs, threshold, n).filter("doc_id is not null").groupBy(F.col("doc_id").alias(doc)).agg(F.min("class_id").alias(root), F.count("*").alias(rows))
    joined = docs.join(kept, docs["doc_id"] == kept[doc], "left").filter(F.col(doc).isNull() | (F.col(root) == F.col(doc)))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = joined.filter(F.col(doc).isNull() | (F.col(rows) == 1)).select(*columns)
    return one.unionByName(joined.filter(F.col(rows) > 1).withColumn(at, place).filter(F.col(at) == 1).select(*columns))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
