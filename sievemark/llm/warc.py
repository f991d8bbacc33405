"""WARC archives without repeated payloads.

Headers are grouped by payload digest; the record with the smallest page_id of a digest keeps the
payload, all others become revisits that name it. The archives are plain WARC 1.1 files, written
and read as text with the record separator as line separator, so that Spark's own file access is
used on both ways. Reading follows the lengths in the headers: a separator inside a payload is
part of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import small_side
from sievemark.session import materialize, scratch_path

CRLF, GAP = "\r\n", "\r\n\r\n"
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"  # the tables carry no crawl time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    """urn:uuid of a page and its payload, the same on every run."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """The line ``name: value``, or nothing if the value is null."""
    flat = F.regexp_replace(value.cast("string"), "[\r\n]", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), flat, F.lit(CRLF)), F.lit(""))


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Only digests that occur more than once are joined back, so payloads move only if those are
    too many to broadcast; then Spark splits a digest with very many pages."""
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).select(
        "page_id", "url", "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    repeated = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    repeated = small_side(materialize(repeated, "repeated-payloads"), 100_000)
    joined = rows.join(repeated, F.col("payload_digest") == F.col("digest"), "left")
    later = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES) -> None:
    """One WARC record per row of ``pages`` (page_id, url, html) below ``path``, gzipped."""
    rows = with_types(pages, least_bytes)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(GAP),
    )
    block_bytes = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    digest = F.col("payload_digest")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), digest)),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), digest))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF + "Content-Length: "),
        block_bytes.cast("string"), F.lit(GAP), http,
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.text(path, compression="gzip", lineSep=GAP)


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose text, cut at every GAP, is ``pieces``."""
    gap, held, size, headers = GAP.encode(), [], 0, None
    for piece in pieces:
        held += [piece, gap]
        size += len(piece) + len(gap)
        while True:
            if headers is None:
                data = b"".join(held).lstrip(b"\r\n") if held else b""
                head, found, rest = data.partition(gap)
                if not found or not head:
                    held, size = ([data] if data else []), len(data)
                    break
                lines = head.decode().split(CRLF)[1:]
                headers = dict(line.split(": ", 1) for line in lines)
                held, size = [rest], len(rest)
            length = int(headers["Content-Length"])
            if size < length + len(gap):
                break
            data = b"".join(held)
            yield headers, data[:length]
            held, headers = [data[length + len(gap) :]], None
            size = len(held[0])
            if not size:
                held = []
                break


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; payload length and digest are measured.

    Gzipped files are not split, so a task sees whole files and keeps one record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (v.as_py() for b in batches for v in b.column(0).cast(pa.binary()))
        rows = []
        for headers, block in _records(pieces):
            payload = block.partition(GAP.encode())[2]
            rows.append(
                {
                    "page_id": headers.get("X-Page-Id"),
                    "record_type": headers["WARC-Type"],
                    "record_id": headers["WARC-Record-ID"],
                    "refers_to_id": headers.get("WARC-Refers-To"),
                    "named_digest": headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                    "payload_bytes": len(payload),
                    "payload_digest": hashlib.sha256(payload).hexdigest(),
                }
            )
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    text = ["page_id", "record_type", "record_id", "refers_to_id", "named_digest"]
    schema = pa.schema(
        [*[(c, pa.string()) for c in text], ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )
    kinds = ", ".join(f"{c} string" for c in text)
    pieces = spark.read.text(path, lineSep=GAP)
    return pieces.mapInArrow(run, f"{kinds}, payload_bytes bigint, payload_digest string")


def resolve(headers: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Give every revisit the payload facts of the response that it names.

    A response whose payload does not have the digest in its header stops the job, and so does a
    revisit without a response."""
    response = F.col("record_type") == "response"
    damaged = F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("record_id")))
    headers = materialize(
        headers.withColumn(
            "payload_digest",
            F.when(response & (F.col("payload_digest") != F.col("named_digest")), damaged.cast("string"))
            .otherwise(F.col("payload_digest")),
        ).withColumn("page_id", F.col("page_id").cast(id_type)),
        "warc-headers",
    )
    responses = headers.where("record_type = 'response'")
    named = materialize(
        responses.select(
            F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"),
            F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"),
        ).distinct(),
        "warc-responses",
    )
    revisits = headers.where("record_type = 'revisit'").join(
        named, F.col("refers_to_id") == F.col("named"), "left"
    )
    lost = F.raise_error(F.concat(F.lit("no response for revisit "), F.col("record_id"))).cast("bigint")
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast(id_type).alias("refers_to"),
    ).unionByName(
        revisits.select(
            "page_id", F.coalesce("full_bytes", lost).alias("payload_bytes"),
            F.col("full_digest").alias("payload_digest"), "record_type", "refers_to",
        )
    )


def round_trip(pages: DataFrame, *, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, read them back and resolve revisits.

    Returns:
        page_id, payload_bytes long, payload_digest string, record_type string, refers_to (the
        response's page_id for revisits). One row per input row. Null html is an empty payload;
        a null url gives no target header; line breaks in a url are escaped. Rows that repeat
        page_id and payload are all responses if theirs is the smallest id. Rows without page_id
        are revisits if a row with one has their payload.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return resolve(read_headers(spark, path), pages.schema["page_id"].dataType.simpleString())
