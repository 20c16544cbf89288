"""Drop lines that an earlier document already holds.

Line keys are hashed, range-partitioned by (hash, document) and sorted within
partitions by document and position, so that each partition streams over its
keys and sees first occurrences first. A very common key spans partitions; for
the first key of each partition the earlier partitions' summaries (at most two
rows a partition) say which document came first. Dropped positions return as
one compressed bitmap per document, and only these meet the texts again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import SPACE_BYTES, Scratch, documents, free_name, slices, with_row_key

MIN_CHARS = 10


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space, A-Z lower-cased; None if under min_chars code points."""
    key = line.strip(SPACE_BYTES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _lines(min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, owner, pos, sizes = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines = (text or b"").split(b"\n")
                for j, line in enumerate(lines):
                    key = line_key(line, min_chars)
                    if key is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(i)
                        pos.append(j)
                        sizes.append(len(lines))
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            own = pa.array(owner, pa.int64())
            yield pa.record_batch([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column("doc_id").take(own), batch.column("row_key").take(own), pa.array(pos, pa.int32()), pa.array(sizes, pa.int32())], schema=schema)

    return run


MARK = "kind int, h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition. kind 0: a line to drop; 1: a line of the partition's first key,
    to drop if an earlier partition holds its key in a smaller document; 2: a key's smallest
    document here, for the first and the last key."""
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
    head = None  # the partition's first key
    key, first, known = None, 0, False  # the current key, its smallest document, whether that is null
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = np.asarray(batch.column("h1")), np.asarray(batch.column("h2"))
        doc = np.asarray(batch.column("doc_id").fill_null(0))
        null = np.asarray(batch.column("doc_id").is_null())
        begin = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
        run = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [n]))))
        low, low_null = doc[begin], null[begin]
        fresh = key != (h1[0], h2[0])
        if head is None:
            head = (h1[0], h2[0])
        if not fresh:
            low, low_null = low.copy(), low_null.copy()
            low[0], low_null[0] = first, known
        later = (doc != low[run]) | (null != low_null[run])
        of_head = (h1 == head[0]) & (h2 == head[1])
        kind = np.where(later, 0, np.where(of_head, 1, 3))
        keep = np.flatnonzero(kind < 3)
        if key is None:
            yield _summary(schema, head, low[0], low_null[0])
        key, first, known = (h1[-1], h2[-1]), low[-1], bool(low_null[-1])
        at = pa.array(keep)
        yield pa.record_batch([pa.array(kind[keep].astype(np.int32)), *(batch.column(c).take(at) for c in ("h1", "h2", "doc_id", "row_key", "pos", "n_lines"))], schema=schema)
    if key is not None and key != head:
        yield _summary(schema, key, first, known)


def _summary(schema: pa.Schema, key: tuple, doc: int, null: bool) -> pa.RecordBatch:
    values = [2, int(key[0]), int(key[1]), None if null else int(doc), None, None, None]
    return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n_lines").to_pylist()
        out = []
        for size, dropped in zip(n, batch.column("dropped"), strict=True):
            keep = np.ones(size, dtype=bool)
            keep[np.asarray(dropped.values)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), batch.column("n_lines"), pa.array(out, pa.binary())], names=["doc_id", "row_key", "n_lines", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Which lines stay: doc_id, row_key, n_lines and keep_bitmap (zlib of packed bits), for rows that lose a line.

    A key of at least min_chars code points found in two documents stays only
    in the smallest doc_id holding it (all its lines there). Rows that share a
    doc_id are one document; a null doc_id is one document after all others.
    row_key is xxhash64(doc_id, text), which tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    raw = with_row_key(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), "row_key")
    lines = scratch.table("keys", raw.mapInArrow(_lines(min_chars), "h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc_id").asc_nulls_last()]
    streamed = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    marks = scratch.table("marks", streamed.mapInArrow(_first_occurrences, MARK))
    scratch.drop("keys")
    # Two rows a range partition at most; written, so that Spark knows the size and chooses the join by it.
    lowest = marks.filter("kind = 2").groupBy("h1", "h2").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("low_doc"))
    lowest = scratch.table("lowest", lowest)
    heads = marks.filter("kind = 1").join(lowest, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("low_doc")))
    cols = ["doc_id", "row_key", "pos", "n_lines"]
    dropped = marks.filter("kind = 0").select(*cols).unionByName(heads.select(*cols))
    per_doc = dropped.groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines int, keep_bitmap binary")


def _apply(bitmap_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _kept_lines(batch, bitmap_name)

    return run


def _kept_lines(batch: pa.RecordBatch, bitmap_name: str) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != bitmap_name]
    texts, n_lines, n_dropped = [], [], []
    for text, bitmap in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(bitmap_name).to_pylist(), strict=True):
        lines = (text or b"").split(b"\n")
        n_lines.append(len(lines))
        if bitmap is not None:
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
            kept = [line for line, k in zip(lines, keep, strict=True) if k]
            n_dropped.append(len(lines) - len(kept))
            text = b"\n".join(kept)
        else:
            n_dropped.append(0)
        texts.append(text)
    columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
    return pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines cut from text, and n_lines (before) and n_dropped.

    Every column of docs is kept (columns n_lines and n_dropped of docs are
    replaced). Text is split at \\n; null text counts as one empty line and
    stays null. Rows keep their number: repeated rows, empty texts and an empty
    table pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, key, bitmap = (free_name(docs, c) for c in ("map_doc", "map_key", "keep_bitmap"))
    maps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("keep_bitmap").alias(bitmap))
    same = docs["doc_id"].cast("long").eqNullSafe(maps[doc]) & (F.xxhash64(docs["doc_id"], docs["text"]) == maps[key])
    joined = docs.join(maps, same, "left").drop(doc, key)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(_apply(bitmap), ", ".join([*fields, "n_lines long", "n_dropped long"]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.*, (s.key IS NOT NULL AND k.doc_id > s.low) AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
