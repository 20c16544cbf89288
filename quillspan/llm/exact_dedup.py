"""Find equal texts by sorting their content.

White space is normalised, and the texts are dealt to ranges between sampled
splitters, then sorted in each range by Spark's external sort, so that equal
texts lie side by side. Each range is streamed once: a text that differs from
the one before it, compared in full, begins a group. Only the rows of a
range's first and last keys can have equals in other ranges; those groups
are settled by one row for each text and range.

Splitters are (first bytes, content hash, doc_id), not whole texts, so the
sample that finds them is small however long the texts are. The hash tells
apart texts that share their beginning, doc_id deals a large group of copies
to several ranges. Neither decides that two texts are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import SPACE_CLASS, Scratch, documents, free_name, slices, with_row_key

#: Bytes of a text that splitters look at before its hash.
HEAD_BYTES = 32

GROUPED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("nth", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("digest", pa.binary())])
GROUPED_DDL = "kind int, doc_id long, row_key long, nth int, keep_id long, group_size long, digest binary"


class _Group:
    """The rows of one text in a range, doc_id ascending with nulls last; texts themselves are kept once."""

    def __init__(self, key: tuple, text: pa.Scalar):
        self.key, self.text = key, text
        self.digest = hashlib.sha256(text.as_buffer()).digest()
        self.docs: list[pa.Array] = []
        self.rows: list[pa.Array] = []

    def add(self, docs: pa.Array, rows: pa.Array) -> None:
        self.docs.append(docs)
        self.rows.append(rows)

    def batches(self, edge: bool) -> Iterator[pa.RecordBatch]:
        """kind 0: a row of a finished group; 1: a row of a group that other ranges may share; 2: what this range knows of such a group."""
        docs, rows = pa.concat_arrays(self.docs), pa.concat_arrays(self.rows)
        n = len(docs)
        ids, null = np.asarray(docs.fill_null(0)), np.asarray(docs.is_null())
        fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
        nth = np.arange(n) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # rows of one doc_id and text are numbered
        low, size = (None if edge else docs[0].as_py()), (None if edge else n)
        full = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(n, np.int64)))
        yield pa.record_batch([full(int(edge), pa.int32()), docs, rows, pa.array(nth.astype(np.int32)), full(low, pa.int64()), full(size, pa.int64()), full(self.digest, pa.binary())], schema=GROUPED)
        if edge:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip([2, None, None, None, docs[0].as_py(), n, self.digest], GROUPED, strict=True)], schema=GROUPED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal texts in one sorted range. Those of the first and the last key (head and hash) are edges: kept back until
    it is known which they are. A key has one text unless hashes collide."""
    first = None  # the range's first key
    group = None
    ended: list[_Group] = []  # finished groups of the current key
    for batch in batches:
        for part in slices(iter([batch])):
            n = part.num_rows
            if not n:
                continue
            head, hashed, text = part.column("head"), part.column("hash"), part.column("norm")
            differs = lambda c: np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)).cast(pa.uint8()), bool)
            new_key = np.concatenate(([True], differs(hashed) | differs(head)))
            begins = np.flatnonzero(new_key | np.concatenate(([True], differs(text))))
            for at, until in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True):
                key = (head[at].as_py(), hashed[at].as_py())
                if group is None or group.key != key or not group.text.equals(text[at]):
                    if group is not None:
                        ended.append(group)
                        if group.key != key:
                            for g in ended:
                                yield from g.batches(edge=g.key == first)
                            ended = []
                    first = key if first is None else first
                    group = _Group(key, text[at])
                group.add(part.column("doc_id").slice(at, until - at), part.column("row_key").slice(at, until - at))
    if group is not None:
        for g in [*ended, group]:
            yield from g.batches(edge=True)


def copies(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, row_key, nth, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Null counts as the empty text. The row with the smallest doc_id stays; a
    null doc_id is larger than any other. Rows that agree in doc_id and text
    are numbered by nth, and of those the first stays. row_key is
    xxhash64(doc_id, text). Other columns are not read; an empty table gives
    none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE_CLASS}+", " ")
    raw = with_row_key(docs).select(F.col("doc_id").cast("long"), "row_key", norm.cast("binary").alias("norm"))
    keyed = raw.select(F.substring("norm", 1, HEAD_BYTES).alias("head"), F.xxhash64("norm").alias("hash"), "doc_id", "row_key", "norm")
    parts, by_id = int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_last()
    ordered = keyed.repartitionByRange(parts, "head", "hash", by_id).sortWithinPartitions("head", "hash", "norm", by_id, "row_key")
    found = scratch.table("found", ordered.mapInArrow(_groups, GROUPED_DDL))
    shown = ["doc_id", "row_key", "nth", "keep_id", "group_size", "digest"]
    # At most a row for each text of a range's first and last key; written, so that Spark knows the size and chooses the join by it.
    edges = found.filter("kind = 2").groupBy("digest").agg(F.min("keep_id").alias("low"), F.sum("group_size").alias("size"))
    edges = scratch.table("edges", edges)
    settled = found.filter("kind = 1").join(edges, "digest").select("doc_id", "row_key", "nth", F.col("low").alias("keep_id"), F.col("size").alias("group_size"), "digest")
    out = found.filter("kind = 0").select(*shown).unionByName(settled)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    return out.select("doc_id", "row_key", "nth", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Of rows that agree in doc_id and text one stays: that whose other columns hash lowest (maps aside, which have no hash).
    """
    doc, key, row, place = (free_name(docs, c) for c in ("copy_doc", "copy_key", "copy_row", "copy_place"))
    stay = copies(docs).filter("kept").select(F.col("doc_id").alias(doc), F.col("row_key").alias(key))
    same = docs["doc_id"].cast("long").eqNullSafe(stay[doc]) & (F.xxhash64(docs["doc_id"], docs["text"]) == stay[key])
    hashed = F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    rows = docs.join(stay, same).select(doc, key, hashed.alias(place), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(row))
    return rows.groupBy(doc, key).agg(F.min_by(row, place).alias(row)).select(f"{row}.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = r"""
WITH normed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM normed WINDOW g AS (PARTITION BY norm)
"""
