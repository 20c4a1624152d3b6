"""WARC archives with revisit records.

Only headers (id, digest) are shuffled to find each payload's first record.
Archives are written by Spark's text writer with the WARC record end (two
CRLFs) as line separator, one archive per task, so any file system that Spark
reaches will do and a lost task is written again. Revisit records hold no
payload; reading joins them to their response by payload digest.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shared_folder

RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Digits of a base-32 number, and the alphabet of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_key string, record_type string, refers_key string, url string, payload_digest string, payload_bytes long, payload binary"


def payload_digest(text: Column) -> Column:
    """Bare base32 SHA-1 of a text's UTF-8 bytes: 40 bits, that is ten hex digits, at a time."""
    hexed = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def resolve_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_digest, payload_bytes, record_type and refers_to to (page_id, url, html).

    Of records with equal payloads of at least ``min_bytes`` bytes, that with
    the smallest page_id is the response and the others revisit it. Null html
    is an empty payload. Rows that repeat both page_id and payload are each
    written as a response; a null page_id sorts last.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("payload"), payload_digest(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    heads = pages.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    heads = materialize(heads.where("n > 1").select("_d", "first"), "warc-heads")
    known = pages.join(heads, (pages.payload_digest == heads._d) & (pages.payload_bytes >= min_bytes), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return known.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(kind: Column, page_id: Column, url: Column, digest: Column, refers: Column, payload: Column) -> Column:
    """The text of a WARC/1.1 record without its record end, with fresh headers."""
    uri = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]+", " ")
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.when(kind == "revisit", head).otherwise(F.concat(head, payload))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), uri(page_id)), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), clean), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)]
    more = F.when(kind == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), uri(refers))).otherwise("")
    end = [F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), more, F.lit("\r\n"), F.concat_ws("\r\n", *end), F.lit("\r\n\r\n"), body)


def write_archives(resolved: DataFrame, path: str) -> None:
    """Gzipped archives of ``resolve_roles``' records, one per task."""
    text = record(F.col("record_type"), F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("refers_to"), F.col("payload"))
    resolved.select(text.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _records(data: bytes) -> Iterator[tuple]:
    """Records of one archive, by their Content-Length; payloads may hold record ends."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        payload = block.partition(b"\r\n\r\n")[2]
        key = lambda u: m[1] if (m := re.match("<urn:page:(.*)>$", u or "")) else u
        fresh = head["warc-type"] != "revisit"
        digest = b32encode(sha1(payload).digest()).decode() if fresh else head["warc-payload-digest"].removeprefix("sha1:")
        if fresh and head["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        yield key(head["warc-record-id"]), head["warc-type"], key(head.get("warc-refers-to")), head["warc-target-uri"], digest, len(payload) if fresh else None, payload if fresh else None


def read_archives(spark, path: str) -> DataFrame:
    """Records of archives, a file per row of the reader; digests are computed anew and checked."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_key", "record_type", "refers_key", "url", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for r in _records(data.as_buffer().to_pybytes() if hasattr(data, "as_buffer") else data.as_py()):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, PARSED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisit records the payload and size of the response with their digest.

    A revisit whose response is in no archive keeps nulls. Responses with equal
    digests (from runs with another bound) count once, by the smallest key.
    """
    full = records.where("record_type <> 'revisit'").groupBy(F.col("payload_digest").alias("_d")).agg(F.min_by(F.struct("payload", "payload_bytes"), "record_key").alias("full"))
    back = records.where("record_type = 'revisit'").drop("payload", "payload_bytes").join(full, F.col("payload_digest") == F.col("_d"), "left")
    back = back.select(*[c for c in records.columns if c not in ("payload", "payload_bytes")], F.col("full.payload").alias("payload"), F.col("full.payload_bytes").alias("payload_bytes"))
    return records.where("record_type <> 'revisit'").unionByName(back)


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes deduplicated archives of ``pages`` and returns their records, read back."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve_roles(pages, min_bytes), path)
    return read_archives(spark, path)


def warc_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives."""
    records = materialize(archive_pages(pages, None, min_bytes).withColumn("payload", F.lit(None).cast("binary")), "warc-records")
    whole = resolve_revisits(records)
    kind = dict(pages.dtypes)["page_id"]
    return whole.select(F.nullif("record_key", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast(kind).alias("refers_to"))
