"""WARC archives: written with an index, read back by coalesced byte ranges.

Every task writes its records to archives of its own in the shared folder and
gives out offset, length, URL and digest of each; these rows are the index,
which Spark's commit protocol keeps to tasks that ended. Reading goes through
it: choose records, merge their sorted ranges where the gaps are small, and
read each merged range at once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import Scratch, slices

#: Payloads under so many bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: Ranges merge over gaps up to GAP bytes, until they have RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20
#: An archive ends with the batch that brings it to so many bytes, and so many bytes make a task of reading where there are more tasks than cores.
ARCHIVE_BYTES, TASK_BYTES = 1 << 30, 256 << 20
INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string"
DATE = "2000-01-01T00:00:00Z"
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """40 hex digits as 32 base-32 letters: five of the former make four of the latter."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, LETTERS)


@dataclass
class Archive:
    """A written archive: its folder and its index."""

    path: str
    index: DataFrame


def _records(pages: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """page_id, url, digest, size, record_type, refers_to and the record as one string; url is the target as the record has it."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("body"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    firsts = rows.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written first, so that the join deals both sides itself and can split a payload that is everywhere.
    firsts = scratch.table("firsts", firsts)
    rows = rows.join(firsts, ["sha", "size"], "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_page")))
    rows = rows.withColumn("digest", base32_of_hex(F.col("sha")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), uri, "sha"))
    urn = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), urn,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), text("size"),
        F.lit("\r\nX-Page-ID: "), text("page_id"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: "), text("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    ]
    return rows.withColumn("record", F.concat(*lines)).withColumn("url", uri)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> Archive:
    """Write one record per row of pages (page_id, url, html) below path, in the shared folder, and their index with them.

    Tasks write archives and give out an index row a record; the index holds
    the rows of tasks that ended, so archives of lost or repeated ones are read
    by nobody. Of equal payloads of at least min_bytes, rows with the smallest
    page_id are responses and the others revisits of it; a null page_id is
    larger than any. Null html is an empty payload, a null url an empty target.
    Rows that repeat get a record each; an empty table gives an empty index.
    Other columns are not read.
    """
    spark = pages.sparkSession
    records = _records(pages, Scratch(spark, "warc"), min_bytes).select("page_id", "url", "digest", "record_type", "record")
    records.mapInArrow(_write(f"{path}/archives"), INDEX).write.parquet(f"{path}/index")
    return open_archives(spark, path)


def open_archives(spark: SparkSession, path: str) -> Archive:
    """What write_archives() has written below path."""
    return Archive(path, spark.read.schema(INDEX).parquet(f"{path}/index"))


def _store(path: str):
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))


def _write(folder: str):
    types = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{folder}/{uuid.uuid4().hex}.warc"
                store, inner = _store(path)
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                out, at = store.open_output_stream(inner), 0
            records = batch.column("record").cast(pa.binary())
            lengths = np.asarray(pc.binary_length(records).cast(pa.int64()))
            out.write(b"".join(records.to_pylist()))
            offsets = at + np.cumsum(lengths) - lengths
            at += int(lengths.sum())
            rows = [pa.array([path] * batch.num_rows, pa.string()), pa.array(offsets), pa.array(lengths), *(batch.column(c) for c in ("page_id", "url", "digest", "record_type"))]
            # These rows count once the task has ended, so after the archive is closed.
            yield pa.record_batch([c.cast(t) for c, (_, t) in zip(rows, types, strict=True)], names=[n for n, _ in types])
            if at >= ARCHIVE_BYTES:
                out = out.close()
        if out is not None:
            out.close()

    return run


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; raises if these are not the first lines of a record."""
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a record: {head[:80]!r}")
    return {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if fields.get(name) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            out = {n: [] for n in names}
            store, inner = _store(row["path"])
            with store.open_input_file(inner) as f:
                data = f.read_at(row["stop"] - row["start"], row["start"])
            for offset, length in sorted((p["offset"], p["length"]) for p in row["parts"]):
                at = offset - row["start"]
                for n, v in zip(names, parse(data[at : at + length]), strict=True):
                    out[n].append(v)
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def parse(record: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of one whole record; raises if it is damaged."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = fields_of(head)
    if block[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise ValueError(f"record of a wrong length: {record[:80]!r}")
    payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    if fields["warc-type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return _number(fields, "x-page-id"), fields["warc-target-uri"], size, digest, fields["warc-type"], _number(fields, "x-refers-to-page-id"), payload


def read_archives(archive: Archive, chosen: DataFrame | None = None, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """Read the chosen rows of the index (all by default) back from the archives.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload; a revisit has the size and digest of the payload it stands for
    and no payload. Payloads of responses are verified against their digests.
    An empty choice gives no row; a row chosen twice is read twice.
    """
    chosen = archive.index if chosen is None else chosen
    # An archive has about ARCHIVE_BYTES, which bounds its rows in the window.
    order = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    gapped = chosen.withColumn("jump", F.coalesce((F.col("offset") - F.lag(end).over(order) > gap).cast("int"), F.lit(0)))
    run = gapped.withColumn("run", F.sum("jump").over(order)).withColumn("cell", F.floor(F.col("offset") / size))
    ranges = run.groupBy("path", "run", "cell").agg(F.min("offset").alias("start"), F.max(end).alias("stop"), F.collect_list(F.struct("offset", "length")).alias("parts"))
    # Ranges are few and small rows; what counts is the bytes they stand for, so these decide how many tasks read.
    total = chosen.agg(F.sum("length")).first()[0] or 0
    cores = chosen.sparkSession.sparkContext.defaultParallelism
    tasks = max(total // TASK_BYTES, min(cores, total // size)) + 1
    placed = ranges.select("path", "start", "stop", "parts").repartition(int(tasks), "path", "start")
    return placed.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "warc").path("pages"))
    return read_archives(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda k:
           substr('{LETTERS}', 1 + ((('0x' || substr(x, 1 + (k // 4) * 5, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS low
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to
FROM d
"""
