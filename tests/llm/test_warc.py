import hashlib

import pytest
from pyspark.sql import functions as F

from sievemark.llm import warc
from sievemark.session import scratch_path

SCHEMA = "page_id long, url string, html string, record_type string, payload string"


def brute(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 100 and page_id is not None:
            first[b] = min(first.get(b, page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        b = (html or "").encode()
        later = len(b) >= 100 and b in first and first[b] != page_id
        digest = hashlib.sha256(b).hexdigest()
        out.append((page_id, len(b), digest, "revisit" if later else "response", first[b] if later else None))
    return sorted(out, key=str)


GAPS = "\r\n\r\n"
PAYLOADS = [
    "x" * 99, "x" * 100, "é" * 60, None, "", GAPS, "a" + GAPS + "b" + GAPS * 30, "line\r\n" * 30 + GAPS + "\r\n",
    "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello" * 9, "\r\n" * 200, "y" * 300_000, "tail\r\n" + "\r" * 120, "\n" * 150,
]


def rows():
    out = [(i, f"http://h/{i}", h, "a", "b") for i, h in enumerate(PAYLOADS)]
    out += [(100 + i, None, h, "a", None) for i, h in enumerate(PAYLOADS)]
    out += [(50 - i, "u\r\nX-Page-Id: 9", h, None, "b") for i, h in enumerate(PAYLOADS[4:])]
    out += [(7, "http://h/7", PAYLOADS[7], "a", "b"), (None, "n", PAYLOADS[1], "a", "b"), (None, "n", "z" * 120, "a", "b")]
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = warc.round_trip(df).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == brute(rows())


def test_archives_hold_each_payload_once(spark):
    df = spark.createDataFrame([(i, "u", "same " * 50, "", "") for i in range(200)], SCHEMA).repartition(4)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path)
    text = "".join(r.value + GAPS for r in spark.read.text(path, lineSep=GAPS).collect())
    assert text.count("same " * 50) == 1 and text.count("WARC-Type: revisit") == 199
    assert "WARC-Refers-To: <urn:uuid:" in text


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "p" * 200, "", ""), (2, "u", "p" * 200, "", "")], SCHEMA)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path)
    headers = warc.read_headers(spark, path)
    with pytest.raises(Exception, match="does not match"):
        warc.resolve(headers.withColumn("payload_digest", F.lit("0"))).collect()
    with pytest.raises(Exception, match="no response"):
        warc.resolve(headers.where("record_type = 'revisit'")).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
