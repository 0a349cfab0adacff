"""Web pages as WARC archives, and archives back into pages.

Writing: one record per page.  A response holds an HTTP message with chunked
framing; a message longer than a segment goes on in ``continuation`` records.
Of pages with equal payloads one is written whole, the others ``revisit`` it.
Archives are gzip files of a bounded number of bounded records, so one file
always fits into a task.

Reading: records are cut out by their length.  Continuation records are grouped
by the id of the record they continue, put in order by segment number, checked
against the total length, and only then is the chunked framing taken off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import scratch_path, settle

#: Payloads shorter than this are never revisited.
REVISIT_BYTES = 100
#: Bytes of an HTTP message in one record, bytes of one chunk, records in one file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16_384, 4_096, 2_000
DATE = "2024-01-01T00:00:00Z"

RECORD = ("record_id string, record_type string, page_id long, refers string, segment int, "
          "total long, block binary, payload_bytes long, payload_digest string")


def record_id(page_id: Column, digest: Column) -> Column:
    """The same for the same page and payload, wherever it is worked out."""
    name = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), *[
        x for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        for x in ((F.lit("-"),) if at > 1 else ()) + (F.substring(name, at, size),)], F.lit(">"))


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of up to ``size`` bytes that never cut a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in _cuts(payload, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """What chunked framing holds; raises if it is cut short or its sizes don't fit."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _line(text: str | None) -> str:
    """A header value: no control characters, so that no header ends early."""
    return "".join(c if c >= " " else " " for c in text or "")


def page_records(page_id, url, payload: bytes, digest: str, own: str, refers: str | None,
                 segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _line(url)),
              ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        common.append(("X-Page-Id", str(page_id)))
    if refers:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", refers), ("Content-Type", "application/http;msgtype=response")],
                      head)
        return
    message = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
               b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload))
    parts = list(_cuts(message, segment_bytes))
    for number, part in enumerate(parts, 1):
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common,
                   ("Content-Type", "application/http;msgtype=response")]
        if number > 1:
            headers = [("WARC-Type", "continuation"), ("WARC-Date", DATE),
                       ("WARC-Record-ID", f"{own[:-1]}-{number}>"), ("WARC-Segment-Origin-ID", own)]
        if len(parts) > 1:
            headers.append(("WARC-Segment-Number", str(number)))
            if number == len(parts):
                headers.append(("WARC-Segment-Total-Length", str(len(message))))
        yield _record(headers, part)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``page_id``, ``url`` and ``html`` as archives; a null html is an empty payload.

    Of equal payloads of at least ``REVISIT_BYTES`` the smallest id is a
    response, repeated rows of it too; a page without an id revisits it.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.cast("binary").alias("payload"), F.sha2(html, 256).alias("digest"))
    # Written first: their measured size, not a guess, decides how they are joined.
    firsts = settle(
        rows.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "firsts")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rows = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        record_id(F.col("page_id"), F.col("digest")).alias("own"),
        F.when(again, record_id(F.col("first"), F.col("digest"))).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                records = [r for page in zip(*[c.to_pylist() for c in part.columns], strict=True)
                           for r in page_records(*page, segment_bytes=segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

    # A record ends with two line ends, which are the writer's line separator.
    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def archive_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of every record."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:  # one member after the other
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(headers["content-length"])
        if at > len(data):
            raise ValueError("a record is cut short")
        yield headers, data[end + 4:at]


def http_payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" in head.lower():
        return dechunked(body)
    return body


def _digest(headers: dict[str, str]) -> str | None:
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    return value.lower() if kind == "sha256" else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Responses, revisits and segments of all archives under ``path``."""

    def row(headers: dict[str, str], block: bytes):
        number = headers.get("warc-segment-number")
        kind = headers.get("warc-type")
        found = {
            "record_id": headers.get("warc-segment-origin-id") or headers.get("warc-record-id"),
            "record_type": kind, "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None,
            "refers": headers.get("warc-refers-to"), "segment": int(number) if number else None,
            "total": int(headers.get("warc-segment-total-length", 0)) or None,
            "block": block if number else None, "payload_bytes": None, "payload_digest": _digest(headers)}
        if kind == "response" and not number:
            payload = http_payload(block)
            found |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                           ("refers", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
                           ("block", pa.binary()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows = [row(h, b) for h, b in archive_records(content.as_py())
                        if h.get("warc-type") in ("response", "revisit", "continuation")]
                for lo in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[lo:lo + 500], types)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """Responses in segments, put together; raises if one is incomplete.

    A message is as long as one page, so its segments fit into a row.  Records
    that were written twice have every segment twice, and give two rows: copies
    of a segment are counted first, so that a record has one block of each.
    """
    once = segments.groupBy("record_id", "segment").agg(
        F.first("block").alias("block"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max("payload_digest").alias("stated"), F.count("*").alias("n"))
    grouped = once.groupBy("record_id").agg(
        F.collect_list(F.struct("segment", "block")).alias("parts"),
        F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("stated").alias("stated"),
        F.max(F.when(F.col("segment") == 1, F.col("n"))).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for parts, total, page_id, stated, copies, name in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                by_number = {p["segment"]: p["block"] for p in parts}
                message = b"".join(by_number[n] for n in sorted(by_number))
                if sorted(by_number) != list(range(1, len(by_number) + 1)) or len(message) != total:
                    raise ValueError(f"record {name} lacks segments: {len(message)} of {total} bytes")
                payload = http_payload(message)
                digest = hashlib.sha256(payload).hexdigest()
                if stated and stated != digest:
                    raise ValueError(f"record {name} has not the payload its digest states")
                for column, value in zip(out, (name, page_id, len(payload), digest, copies), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())],
                names=["record_id", "page_id", "payload_bytes", "payload_digest", "copies"])

    whole = grouped.select("parts", "total", "page_id", "stated", "copies", "record_id").mapInArrow(
        run, "record_id string, page_id long, payload_bytes long, payload_digest string, copies long")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page in the archives, revisits resolved to the response they refer to."""
    # Written once without the blocks of whole records; segments are read from it as well.
    records = settle(read_records(spark, path), "records")
    whole = records.where((F.col("record_type") == "response") & F.col("segment").isNull())
    columns = ["record_id", "page_id", "payload_bytes", "payload_digest"]
    responses = whole.select(*columns).union(
        reassembled(records.where(F.col("segment").isNotNull())).select(*columns))
    responses = settle(responses, "responses")
    targets = settle(responses.groupBy(F.col("record_id").alias("refers")).agg(
        F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes")), "targets")
    revisits = records.where(F.col("record_type") == "revisit").select(
        "page_id", "payload_digest", "refers").join(targets, "refers", "left")
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    ).union(revisits.select("page_id", "payload_bytes", "payload_digest",
                            F.lit("revisit"), "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the scratch folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_pages(pages.sparkSession, path)


ORACLE = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
    strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest)
    END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM f
"""
