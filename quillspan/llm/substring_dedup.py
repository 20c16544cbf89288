"""Remove repeated passages: seed on winnowed anchors, extend both ways, keep repeats over a length.

A window is `length` consecutive words. Winnowing picks for each window the
smallest hash among its `anchor` word runs, so equal windows pick equal anchors
at equal places: the anchors are the seeds. Consecutive windows of one anchor
form a stretch. Occurrences join on their anchor. Those whose stretches are
equal repeat as a whole. Where stretches around an anchor differ, one of each
kind joins with the most common kind, its pivot, and the match is extended to
the left and to the right as far as the words agree: a maximal repeat with the
pivot. Windows beyond it equal no window of the pivot, nor of whatever matches
that; what is left of the kinds is compared window by window. Repeats of at
least `length` words lose all their words.

Nothing is compared in pairs: every kind meets one pivot, and equal stretches
and windows are counted by hash, however many copies there are. Words are told
apart by 64-bit hashes, spans by two polynomials of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, SpanHash, WordHashes, as_long, documents, slices, with_row_key

LENGTH = 35
ANCHOR = 8
#: Odd multipliers of the two independent polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Windows are packed as first window * 1024 + number of windows; a seed as that * 1024 + place of its anchor, counted from the first window.
PACK = 1024


class Windows:
    """Word hashes of a batch of texts, laid end to end."""

    def __init__(self, length: int):
        self.length, self.cache, self.hashes = length, WordHashes(), [SpanHash(b) for b in BASES]

    def load(self, texts: list[bytes | None]) -> "Windows":
        words = [(t or b"").split() for t in texts]
        self.n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.starts = np.concatenate(([0], np.cumsum(self.n_words)))
        values = np.concatenate([self.cache.of(w) for w in words]) if words else np.zeros(0, np.uint64)
        for h in self.hashes:
            h.load(values)
        self.n_windows = np.maximum(self.n_words - self.length + 1, 0)
        return self

    def window_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """The document and the first word of every window."""
        doc = np.repeat(np.arange(len(self.n_words)), self.n_windows)
        before = np.cumsum(self.n_windows) - self.n_windows
        return doc, np.arange(len(doc)) - before[doc] + self.starts[doc]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the smallest of values[i : i + width], for each i."""
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        left = a <= b
        low, at, span = np.where(left, a, b), np.where(left, at[:-step], at[step:]), span + step
    return at


def _stretches(length: int, anchor: int):
    schema = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(length)
        for batch in slices(batches):
            w.load(batch.column("text").to_pylist())
            doc, first = w.window_starts()
            if not len(first):
                continue
            grams = np.arange(w.starts[-1] - anchor + 1)
            value = w.hashes[0].spans(grams, grams + anchor)
            seed = smallest(value, length - anchor + 1)[first]
            new = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
            n = np.diff(np.concatenate((new, [len(seed)])))
            begin, owner = first[new], doc[new]
            out = [as_long(value[seed[new]]), as_long(w.hashes[1].spans(begin, begin + n + length - 1))]
            own = pa.array(owner)
            at = ((begin - w.starts[owner]) * PACK + n) * PACK + seed[new] - begin
            yield pa.record_batch([pa.array(out[0]), pa.array(out[1]), batch.column("doc_id").take(own), batch.column("row_key").take(own), pa.array(at)], schema=schema)

    return run


def _expand(packed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each packed stretch as its windows: owner and window number."""
    n = packed % PACK
    before = np.cumsum(n) - n
    which = np.repeat(np.arange(len(n)), n)
    return owner[which], packed[which] // PACK + np.arange(len(which)) - before[which]


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null lists are empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), sizes)


def _contexts(length: int, anchor: int):
    """Per kind of stretch, the hashes of its words from the anchor to the left, and from the anchor to the right."""
    schema = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("at", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            kinds = batch.column("kinds").flatten()
            own = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("kinds").value_lengths())))
            texts = [cache.of((t or b"").split()).view(np.int64) for t in batch.column("text").to_pylist()]
            at = np.asarray(kinds.field("at"))
            first, n, place = at // PACK // PACK, at // PACK % PACK, at % PACK
            left, right = [], []
            for i, f, k, p in zip(own.to_pylist(), first.tolist(), n.tolist(), place.tolist(), strict=True):
                words = texts[i][f : f + k + length - 1]
                left.append(np.ascontiguousarray(words[:p][::-1]))
                right.append(words[p + anchor :])
            yield pa.record_batch([kinds.field("a"), kinds.field("s"), kinds.field("n"), batch.column("doc_id").take(own), batch.column("row_key").take(own), pa.array(at), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], schema=schema)

    return run


def _agree(one: Column, two: Column) -> Column:
    """How many elements two arrays begin with in common."""
    differ = F.array_position(F.zip_with(one, two, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(one)).otherwise(differ - 1).cast("long")


def _window_hashes(length: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(length)
        for batch in slices(batches):
            w.load(batch.column("text").to_pylist())
            owner, window = _expand(*_listed(batch.column("unsure")))
            begin = w.starts[owner] + window
            h1, h2 = (as_long(h.spans(begin, begin + length)) for h in w.hashes)
            own = pa.array(owner)
            yield pa.record_batch([pa.array(h1), pa.array(h2), batch.column("doc_id").take(own), batch.column("row_key").take(own), pa.array(window * PACK + 1)], schema=schema)

    return run


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept, spans = [], [], [], []
            marks, texts = batch.column("marks"), batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                words = (text or b"").split()
                n = len(words)
                packed = np.asarray(marks[i].values) if marks[i].is_valid else ()
                out, edges = words, []
                if len(packed):
                    first, count = packed // PACK, packed % PACK
                    delta = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(delta, first, 1)
                    np.add.at(delta, first + count + length - 1, -1)
                    gone = np.cumsum(delta[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).tolist()
                    bounds = [0, *edges, n]
                    out = [x for k in range(0, len(bounds), 2) for x in words[bounds[k] : bounds[k + 1]]]
                n_words.append(n)
                n_removed.append(n - len(out))
                kept.append(b" ".join(out))
                spans.append(edges)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int32()))], schema=schema)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Cut every word that lies in a repeated window of `length` words.

    docs: doc_id (any integer, null allowed) and text; other columns are not
    read. Returns one row per row of docs: doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and spans (starts and ends of
    removed word ranges, alternating). Null or empty text has no words; texts
    under `length` words lose nothing; rows that repeat, doc_id included, count
    as occurrences of each other. An empty table gives an empty table.
    """
    if not 1 <= anchor <= length < PACK:
        raise ValueError(f"need 1 <= anchor <= length < {PACK}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    docs = with_row_key(docs)
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), "row_key")
    found = "a long, s long, doc_id long, row_key long, at long"
    seeds = scratch.table("seeds", raw.mapInArrow(_stretches(length, anchor), found))

    # Anchors found twice or more; `mixed` where their stretches differ.
    twice = seeds.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).filter("n > 1").select("a", (F.col("lo") != F.col("hi")).alias("mixed"))
    twice = scratch.table("twice", twice)  # read anew, the join deals both sides itself and can split a common seed
    shared = scratch.table("shared", seeds.join(twice, "a"))
    scratch.drop("seeds", "twice")
    kinds = shared.filter("mixed").groupBy("a", "s").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "at")).alias("one"))
    kinds = scratch.table("kinds", kinds)
    windows_of = F.floor(F.col("at") / PACK).cast("long")
    whole = shared.filter("not mixed").select("doc_id", "row_key", windows_of.alias("at"))
    alike = shared.filter("mixed").join(kinds.filter("n > 1").select("a", "s"), ["a", "s"], "left_semi")
    whole = whole.unionByName(alike.select("doc_id", "row_key", windows_of.alias("at")))

    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"doc_id": "r_doc", "row_key": "r_key"})
        return left.join(right, (left.row_key == right.r_key) & left.doc_id.eqNullSafe(right.r_doc), how).drop("r_doc", "r_key")

    listed = kinds.groupBy("one.doc_id", "one.row_key").agg(F.collect_list(F.struct("a", "s", "n", F.col("one.at").alias("at"))).alias("kinds"))
    contexts = beside(raw, listed, "inner").mapInArrow(_contexts(length, anchor), "a long, s long, n long, doc_id long, row_key long, at long, left array<long>, right array<long>")
    contexts = scratch.table("contexts", contexts)
    pivots = contexts.groupBy("a").agg(F.max_by(F.struct("s", "doc_id", "row_key", "at", "left", "right"), F.struct("n", "s")).alias("pivot"))
    pivots = scratch.table("pivots", pivots)  # read anew, as above
    met = contexts.join(pivots, "a").filter("s != pivot.s")
    first, n, place = (F.floor(F.col("at") / (PACK * PACK)).cast("long"), F.floor(F.col("at") / PACK).cast("long") % PACK, F.col("at") % PACK)
    # Windows within the match, counted from the first of the kind: those that begin not before it and end not after it.
    low = F.least(F.col("n_windows"), F.greatest(F.lit(0), F.col("place") - F.col("to_left")))
    high = F.least(F.col("n_windows"), F.col("place") + anchor + F.col("to_right") - length + 1)
    met = met.select("doc_id", "row_key", first.alias("first"), n.alias("n_windows"), place.alias("place"), F.col("pivot.doc_id").alias("p_doc"), F.col("pivot.row_key").alias("p_key"), F.col("pivot.at").alias("p_at"),
        _agree(F.col("left"), F.col("pivot.left")).alias("to_left"), _agree(F.col("right"), F.col("pivot.right")).alias("to_right"))
    met = scratch.table("met", met.withColumn("low", low).withColumn("high", F.greatest(high, low)))
    repeats = met.filter("high > low")
    p_first, p_place = F.floor(F.col("p_at") / (PACK * PACK)).cast("long"), F.col("p_at") % PACK
    count = F.col("high") - F.col("low")
    ours = repeats.select("doc_id", "row_key", ((F.col("first") + F.col("low")) * PACK + count).alias("at"))
    theirs = repeats.select(F.col("p_doc").alias("doc_id"), F.col("p_key").alias("row_key"), ((p_first + p_place - F.col("place") + F.col("low")) * PACK + count).alias("at"))
    whole = whole.unionByName(ours).unionByName(theirs.distinct())
    before = F.when(F.col("low") > 0, F.col("first") * PACK + F.col("low"))
    after = F.when(F.col("high") < F.col("n_windows"), (F.col("first") + F.col("high")) * PACK + F.col("n_windows") - F.col("high"))
    # Without a match low and high are equal, and the two parts are all windows.
    left_over = met.select("doc_id", "row_key", F.explode(F.array(before, after)).alias("at")).filter("at is not null")
    unsure = left_over.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("unsure"))
    windows = beside(raw, unsure, "inner").mapInArrow(_window_hashes(length), "h1 long, h2 long, doc_id long, row_key long, at long")
    windows = scratch.table("windows", windows)
    again = windows.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    again = scratch.table("again", again)
    single = windows.join(again, ["h1", "h2"], "left_semi").select("doc_id", "row_key", "at")
    marks = scratch.table("marks", whole.unionByName(single).groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("marks")))
    scratch.drop("shared", "kinds", "contexts", "pivots", "met", "windows", "again")
    joined = beside(raw, marks, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string, spans array<int>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM words WHERE len(w) >= {LENGTH})
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM again CROSS JOIN range({LENGTH}) t(k)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
