"""WARC archives of captures: writing, reading back and transaction assembly.

A capture is written as a request record, a response (or revisit) record and
a metadata record.  Request and metadata name the response in
``WARC-Concurrent-To``; assembly joins the three through it and gives one
nested row for each capture.

Payloads are hashed in the scan.  The smallest page_id of each digest of at
least ``REVISIT_BYTES`` bytes is found by a pre-aggregated minimum; its
capture holds the payload, the others are revisits that name it.  Records are
strings that Spark's text writer separates by the two line ends that close a
WARC record, so the archives go to any store that Spark can write.  Reading
follows ``Content-Length``; a payload may hold anything, record headers
included.

Cases: a null payload is empty; a null url is written as an empty target; a
null page_id gets records without a page number and sorts after all ids when the
first of equal payloads is chosen; rows that repeat a page_id are captures of
their own, and of equal payloads under one id (or none) one is the response, by
url and then by place in the table; very long payloads are written whole; an empty table gives no archive
and no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
#: Records in one archive file; files are read whole, so this bounds a reader's memory.
FILE_RECORDS = 6000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STATUS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    named = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:loom:"), record_id, F.lit(f">\r\nWARC-Date: {DATE}\r\n"), *named,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest, n, and of revisits the response: revisit, refers_to (its page), refers_n, refers_url.

    ``n`` numbers the rows as the scan gives them.  It tells apart rows of one
    page, url and payload alone, so that one of them is the response.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"),
        F.sha2(html, 256).alias("digest"), F.monotonically_increasing_id().alias("n"),
    )
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "n")
    first = own.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(rank).alias("first"))
    joined = own.join(first, "digest", "left")
    of = lambda c: F.when(F.col("revisit"), F.col(f"first.{c}"))
    joined = joined.withColumn("revisit", F.coalesce(rank > F.col("first"), F.lit(False)))
    return joined.select("page_id", "url", "html", "size", "digest", "n", "revisit", of("page_id").alias("refers_to"), of("n").alias("refers_n"), of("url").alias("refers_url"))


def write(pages: DataFrame, path: str) -> None:
    """Write the archives of ``pages`` (page_id, url, html) under ``path``."""
    c = captures(pages).withColumns({k: F.col(k).cast("string") for k in ("n", "refers_n")})
    own, request, metadata = (F.concat(F.col("n"), F.lit(x)) for x in ("-c", "-q", "-m"))
    flat = lambda name: F.regexp_replace(name, r"[\r\n]+", " ")
    page = ("X-Page-ID", F.col("page_id").cast("string"))
    target = ("WARC-Target-URI", flat("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    partner = ("WARC-Concurrent-To", F.concat(F.lit("<urn:loom:"), own, F.lit(">")))
    refers = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<urn:loom:"), F.col("refers_n"), F.lit("-c>"))), ("WARC-Refers-To-Target-URI", flat("refers_url")), ("WARC-Refers-To-Date", F.lit(DATE)), ("X-Refers-To-Page", F.col("refers_to").cast("string"))]
    answer = F.when(F.col("revisit"), _record("revisit", own, [target, page, digest, *refers], F.lit(STATUS))).otherwise(
        _record("response", own, [target, page, digest, ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(F.lit(STATUS), F.col("html")))
    )
    asked = _record("request", request, [target, partner, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), target[1], F.lit(" HTTP/1.1" + END)))
    fields = _record("metadata", metadata, [partner, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-length: "), F.col("size").cast("string"), F.lit("\r\n")))
    out = c.select(F.explode(F.array(asked, answer, fields)).alias("value"))
    out.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes):
    """(headers, block) of each record; an archive may be gzipped as a whole or by record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record ends early")
        yield headers, block


RECORDS = "record_id string, concurrent_to string, type string, page_id long, url string, refers_to long, digest string, size long, http string"


def records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path``; size and digest are of a response's own payload."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for h, block in parse(content.as_py()):
                    kind, payload, size, digest = h["warc-type"], None, None, h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    http, _, body = block.partition(END.encode())
                    if kind == "response":
                        payload, size = body, len(body)
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"the payload of {h['warc-record-id']} is damaged")
                    elif kind == "metadata":
                        own = dict(x.split(": ", 1) for x in block.decode().splitlines())
                        size = int(own["payload-length"])
                    number = lambda x: int(x) if x else None
                    rows.append((h["warc-record-id"], h.get("warc-concurrent-to"), kind, number(h.get("x-page-id")), h.get("warc-target-uri"), number(h.get("x-refers-to-page")), digest, size, http.decode("utf-8", "replace"), payload))
                    if len(rows) >= 1000:
                        yield _batch(rows, with_payload)
                        rows = []
                if rows:
                    yield _batch(rows, with_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORDS + (", payload binary" if with_payload else ""))


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, request, response, metadata)."""
    capture = F.coalesce("concurrent_to", "record_id")
    whole = F.struct(*found.columns)
    of = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), whole), ignorenulls=True)
    return found.groupBy(capture.alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def roundtrip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return assemble(records(spark, path))


def query(spark, sf_dir):
    c = roundtrip(common.read(spark, sf_dir, "pages"))
    return c.select(
        F.col("response.page_id").alias("page_id"),
        F.col("metadata.size").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
