"""WARC archives with revisit records.

Records are written by Spark's text writer with the record separator as line separator, one gzip member a file, so
tasks commit their archives like any other output and may be repeated.  They are read by whole file and parsed as a
stream.  Deduplication moves headers only: they meet by payload digest (counted before the shuffle), the least
page becomes the response, the others are matched to it in a join that may be split, and each
archive is rewritten with its own revisits, with fresh headers.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import Workspace

MIN_BYTES = 100
RECORDS_PER_FILE = 5000
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = ("path string, ordinal bigint, record_type string, record_id string, page_id string, url string, date string, "
           "payload_digest string, payload_bytes bigint, refers_to_id string")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A response record for each row; null payloads are empty, null ids and urls leave their header out."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    http = _text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.octet_length(payload).cast("string"), END)
    block = F.concat(http.cast("binary"), payload)
    clean = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20")
    header = _text(
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:", F.uuid(), f">\r\nWARC-Date: {date}\r\n",
        F.coalesce(_text("WARC-Target-URI: ", clean, "\r\n"), F.lit("")),
        F.coalesce(_text("X-Page-ID: ", F.regexp_replace(F.col(id_col).cast("string"), r"[\r\n]", " "), "\r\n"), F.lit("")),
        "WARC-Payload-Digest: sha256:", F.sha2(payload, 256),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(block).cast("string"), END)
    _write(pages.select(F.concat(header.cast("binary"), block).alias("record")), path, records_per_file)


def _write(records: DataFrame, path: str, records_per_file: int) -> None:
    (records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(content: bytes):
    """(headers, block) of each record of a gzip archive, one at a time."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records, with size and digest of the payload that is there (for revisits, from the header, size null)."""

    def rows(batches):
        names = [c.split()[0] for c in HEADERS.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                out = {n: [] for n in names}
                for ordinal, (h, block) in enumerate(parse(content.as_py())):
                    here = h["warc-type"] == "response"
                    payload = _payload(block) if here else b""
                    digest = hashlib.sha256(payload).hexdigest() if here else h["warc-payload-digest"].partition(":")[2]
                    values = (file.as_py(), ordinal, h["warc-type"], h["warc-record-id"], h.get("x-page-id"), h.get("warc-target-uri"),
                              h["warc-date"], digest, len(payload) if here else None, h.get("warc-refers-to"))
                    for n, v in zip(names, values):
                        out[n].append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], pa.int64() if n in ("ordinal", "payload_bytes") else pa.string()) for n in names], names=names)

    return _files(spark, path).mapInArrow(rows, HEADERS)


def _fresh(h: dict, block: bytes, first) -> bytes:
    """A record with new headers; with ``first``, a revisit of that record without the payload."""
    payload = _payload(block)
    digest = hashlib.sha256(payload).hexdigest()
    kept = block[:len(block) - len(payload)] if first else block
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {h['warc-record-id']}",
             f"WARC-Date: {h['warc-date']}"]
    lines += [f"{name}: {h[name.lower()]}" for name in ("WARC-Target-URI", "X-Page-ID") if name.lower() in h]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(kept).hexdigest()}"]
    if first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Date: {first['date']}"]
        lines += [f"WARC-Refers-To-Target-URI: {first['url']}"] if first["url"] is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(kept)}"]
    return ("\r\n".join(lines) + END).encode() + kept


def deduplicate(ws: Workspace, spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES,
                numeric_ids: bool = True, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Rewrite response archives so that of equal payloads of at least ``min_bytes`` only the least page keeps its payload.

    Pages are ordered by id (as numbers if ``numeric_ids``), then by place in the archives; pages without an id come last.
    """
    headers = ws.save(read_archives(spark, source))
    number = F.col("page_id").cast("bigint") if numeric_ids else F.col("page_id")
    rank = F.struct(number.isNull().alias("none"), number.alias("number"), "path", "ordinal", "record_id", "url", "date")
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = large.join(firsts, ["payload_digest", "payload_bytes"]).where(F.col("record_id") != F.col("first.record_id"))
    # as many as an archive has records
    revisits = matched.groupBy("path").agg(F.collect_list(F.struct("ordinal", F.col("first.record_id").alias("record_id"),
                                                                   F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("revisits"))

    def rewrite(batches):
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1)):
                known = {r["ordinal"]: r for r in revisits.as_py() or []}
                held, size = [], 0
                for ordinal, (h, block) in enumerate(parse(content.as_py())):
                    held.append(_fresh(h, block, known.get(ordinal)))
                    size += len(held[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    joined = _files(spark, source).join(revisits, "path", "left").select("content", "revisits")
    _write(joined.mapInArrow(rewrite, "record binary"), target, records_per_file)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size, digest and page id of the response that a revisit refers to."""
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"))
    plain = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(responses, "refers_to_id", "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    return plain.union(revisits)


def archive_pages(ws: Workspace, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = MIN_BYTES, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write pages as archives, deduplicate these, read the result: per page id, payload size and digest, record type and page referred to.

    Null payloads are empty.  Payloads below ``min_bytes`` are all responses.  Rows repeated with one id are
    records of their own, the first in archive order being the response.  Other columns are not read.  An empty table
    gives an empty result.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    raw, clean = f"{ws.root}/raw", f"{ws.root}/deduplicated"
    write_archives(pages, raw, id_col, url_col, payload_col, records_per_file=records_per_file)
    deduplicate(ws, spark, raw, clean, min_bytes, kind in ("tinyint", "smallint", "int", "bigint"), records_per_file)
    records = ws.save(read_archives(spark, clean))
    return resolved(records).select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                                    F.col("refers_to").cast(kind).alias("refers_to"))
