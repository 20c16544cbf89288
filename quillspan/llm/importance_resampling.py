"""Draw documents that look like a target: importance weights over hashed word runs.

Features are hashed by CRC-32. The distinct features of a batch are grouped by
length, so that a group is a matrix of bytes; one step per column updates the
checksums of all its rows, and the buckets are scattered back to where the
features stand. Counts of buckets are summed in tasks before they are
shuffled: a task sends a row a bucket, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions.ordered import numbered
from quillspan.llm.common import Scratch, documents, free_name, slices, with_row_key

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

#: Bytes of words, A-Z lower-cased; all others part words.
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def _crc_table() -> np.ndarray:
    """Checksums of single bytes under the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()
#: Bytes of one matrix: longer lists of equal length are checksummed in several.
MATRIX_BYTES = 16 << 20


def crc32_all(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of every feature: a matrix for each length, a step for each column."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    out = np.zeros(len(features), np.uint32)
    if not features:
        return out
    begins = np.flatnonzero(np.concatenate(([True], np.diff(sizes[order]) > 0)))
    for first, last in zip(begins, [*begins[1:], len(features)], strict=True):
        width = int(sizes[order[first]])
        step = max(1, MATRIX_BYTES // max(1, width))
        for at in range(first, last, step):
            rows = order[at : min(at + step, last)]
            matrix = np.frombuffer(b"".join([features[i] for i in rows]), np.uint8).reshape(len(rows), width)
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in matrix.T:
                crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[rows] = ~crc
    return out


class Hashed:
    """Buckets of the features of texts, remembered for at most `limit` features from batch to batch."""

    def __init__(self, buckets: int, max_run: int, limit: int = 400_000):
        self.buckets, self.max_run, self.limit = buckets, max_run, limit
        self.known: dict[bytes, int] = {}

    def features(self, text: bytes | None) -> tuple[list[bytes], int]:
        """All runs of 1 to max_run words, repeats included, and the number of words."""
        words = (text or b"").translate(_FOLD).split()
        out = list(words)
        for n in range(2, self.max_run + 1):
            out += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
        return out, len(words)

    def of(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, int]]:
        """For every text the buckets of its features, and its number of words."""
        found = [self.features(t) for t in texts]
        new = list(set().union(*(f for f, _ in found)).difference(self.known)) if found else []
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(set().union(*(f for f, _ in found)))
        self.known.update(zip(new, (crc32_all(new) % self.buckets).tolist(), strict=True))
        for features, n in found:
            yield np.fromiter(map(self.known.__getitem__, features), np.int64, len(features)), n


def _counter(buckets: int, max_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, counts = Hashed(buckets, max_run), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(iter([batch])):
                for found, _ in hashed.of(part.column("text").to_pylist()):
                    counts += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """bucket and n, how many features of all texts it holds; buckets without one have no row. Nulls hold none."""
    raw = texts.select(F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(_counter(buckets, max_run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """bucket and gain for every bucket: thousandths of the log ratio of its smoothed shares in target and docs, rounded down."""
    own, wanted = (bucket_counts(t, buckets, max_run).withColumnRenamed("n", name) for t, name in ((docs, "s"), (target, "t")))
    counts = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(wanted, "bucket", "left").na.fill(0)
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    double = lambda c: c.cast("double")
    ratio = double(F.col("t") + 1) * double(F.col("all_s") + buckets) / (double(F.col("s") + 1) * double(F.col("all_t") + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _weigher(gains: np.ndarray, max_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(len(gains), max_run)
        for batch in batches:
            for part in slices(iter([batch])):
                rows = [(len(found), n, int(gains[found].sum())) for found, n in hashed.of(part.column("text").to_pylist())]
                columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
                yield pa.record_batch([part.column("doc_id"), part.column("row_key"), *columns], names=["doc_id", "row_key", "n_features", "n_words", "weight"])

    return run


def perturbation(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that is fixed by seed and id, rounded down: adding it draws without replacement by weight. A null id hashes as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def rank_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, row_key, n_features, n_words, weight, score and rank.

    rank is 1, 2, 3... for the percent of the documents with min_words words
    that score highest, ties to the smaller doc_id (null last), and null for
    all others. Null and empty texts have no features and weight 0. row_key is
    xxhash64(doc_id, text); rows that agree in it follow each other. Other
    columns are not read; an empty table gives no rows; an empty target gives
    words a lower gain the more often docs has them. What goes to tasks is one
    number for each of `buckets`.
    """
    scratch = Scratch(docs.sparkSession, "resampled")
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(docs, target, buckets, max_run).collect():  # a row a bucket
        gains[r.bucket] = r.gain
    raw = with_row_key(docs).select(F.col("doc_id").cast("long"), "row_key", F.col("text").cast("binary").alias("text"))
    weighed = raw.mapInArrow(_weigher(gains, max_run), "doc_id long, row_key long, n_features long, n_words long, weight long")
    weighed = scratch.table("weighed", weighed.withColumn("score", F.col("weight") + perturbation(F.col("doc_id"), seed)))
    # Those with enough words come first, so that their numbers are their ranks.
    ready = F.col("n_words") >= min_words
    placed = numbered(weighed, [ready.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_key").asc()], "place")
    drawn = percent * weighed.filter(ready).count() // 100
    return placed.withColumn("rank", F.when(ready & (F.col("place") <= drawn), F.col("place"))).drop("place")


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents that rank_documents() draws, with all their columns and rank (which replaces a column of that name).

    Of rows that agree in doc_id and text as many stay as were drawn.
    """
    docs = docs.drop("rank")
    doc, key, times, first, nth = (free_name(docs, c) for c in ("drawn_doc", "drawn_key", "drawn_times", "drawn_first", "drawn_nth"))
    drawn = rank_documents(docs, target, **settings).filter("rank is not null")
    drawn = drawn.groupBy(F.col("doc_id").alias(doc), F.col("row_key").alias(key)).agg(F.count("*").alias(times), F.min("rank").alias(first))
    same = docs["doc_id"].cast("long").eqNullSafe(drawn[doc]) & (F.xxhash64(docs["doc_id"], docs["text"]) == drawn[key])
    order = Window.partitionBy(doc, key).orderBy(first)  # rows that agree are alike
    rows = docs.join(drawn, same).withColumn(nth, F.row_number().over(order)).filter(F.col(nth) <= F.col(times))
    return rows.withColumn("rank", F.col(first) + F.col(nth) - 1).drop(doc, key, times, first, nth)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rank_documents(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH table_of AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) t(i))
), split AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS MATERIALIZED (
  SELECT side, doc_id, word, count(*) AS c FROM split GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT word, (xor(list_reduce([4294967295::UBIGINT] || list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::UBIGINT),
    lambda a, b: xor(crcs[(xor(a, b) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM (SELECT DISTINCT word FROM counted), table_of
), sums AS (
  SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, totals
), weighed AS (
  SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
