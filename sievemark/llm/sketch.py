"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range.

A long document keeps more hashes than a short one, so the share of a short document's hashes that
a long one has estimates containment even between very unequal lengths. Sketches merge by union.
A text none of whose hashes is below the threshold keeps its smallest hash; a union that has a
hash below drops such remainders, so merging still gives the sketch of the merged shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sievemark.llm.common import partitions_of

SHINGLE = 5
# Hashes are the first 16 hex digits of MD5; those below this are kept, a quarter.
THRESHOLD = "4000000000000000"
DIGITS = 16

Sketch = frozenset[str]


def _limit(kept: set[str] | Sketch, threshold: str) -> Sketch:
    below = frozenset(h for h in kept if h < threshold)
    return below or frozenset(sorted(kept)[:1])


def shingle_hashes(words: list[bytes], known: list[str] = (), shingle: int = SHINGLE) -> list[str]:
    """Hash of every shingle in order; the first ones may be given as ``known``. Fewer words than
    a shingle are one shingle as a whole; no words have none."""
    if not words:
        return []
    if len(words) < shingle:
        return [hashlib.md5(b" ".join(words)).hexdigest()[:DIGITS]]
    done = len(known)
    rest = words[done:]
    joined = b" ".join(rest)
    ends = (np.cumsum([len(w) + 1 for w in rest]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    md5 = hashlib.md5
    return [*known, *[md5(joined[a:b]).hexdigest()[:DIGITS] for a, b in zip(starts, ends[shingle - 1 :])]]


def sketch(hashes: list[str], threshold: str = THRESHOLD) -> Sketch:
    return _limit(set(hashes), threshold)


def merge(a: Sketch, b: Sketch, threshold: str = THRESHOLD) -> Sketch:
    """Sketch of the union of both shingle sets."""
    return _limit(a | b, threshold)


def likeness(a: Sketch, b: Sketch) -> float:
    """Common hashes of all hashes; 1 if there are none at all."""
    union = len(a | b)
    return len(a & b) / union if union else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Share of a's hashes that b has; 1 if a has none."""
    return len(a & b) / len(a) if a else 1.0


def fingerprint(found: Sketch) -> str:
    return "".join(sorted(found))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _same_start(a: list[bytes], b: list[bytes]) -> int:
    """Number of equal words at the start."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def _in_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt to ranges of doc_id, with ``bucket`` and ``guest``.

    The largest document of a range is also sent, as a guest, to the range above, where it follows
    the smallest; that of the last range goes to the first. Only the largest id of each range
    reaches the driver, so as many numbers as there are ranges."""
    ranges = 4 * partitions_of(docs)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("bigint"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    dealt = rows.select("key").repartitionByRange(ranges, "key")
    tops = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("top")).collect()
    bounds = np.unique(np.array([r.top for r in tops], np.int64))
    if not len(bounds):
        return rows.withColumn("bucket", F.lit(0)).withColumn("guest", F.lit(False))

    @F.pandas_udf("array<int>")
    def buckets(keys: pd.Series) -> pd.Series:
        own = np.minimum(np.searchsorted(bounds, keys.to_numpy()), len(bounds) - 1)
        last = bounds[own] == keys.to_numpy()
        return pd.Series([[k, (k + 1) % len(bounds)] if t else [k] for k, t in zip(own.tolist(), last)])

    placed = rows.select("doc_id", "text", "key", F.posexplode(buckets("key")).alias("copy", "bucket"))
    return placed.withColumn("guest", F.col("copy") > 0).drop("copy")


def sketches_with_edits(
    docs: DataFrame, *, shingle: int = SHINGLE, threshold: str = THRESHOLD
) -> DataFrame:
    """Sketch of every document and of its edited text.

    Documents follow each other by descending doc_id, null last, equal ids by text; after the last
    comes the first. The edited text has its last half replaced by the start of the next document.
    Ranges of ids are sorted in tasks that read on from one document to the next.

    Args:
        docs: ``doc_id`` long, ``text``; other columns are not read.

    Returns:
        doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited,
        near_next, in_edited double (likeness, and containment of the document in its edited
        text). One row per input row; null is the empty text, whose fingerprint is empty. A single
        document follows itself.
    """
    if not isinstance(docs.schema["doc_id"].dataType, LongType):
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def describe(doc: tuple, following: tuple) -> tuple:
        doc_id, text, words, hashes, found = doc
        changed = edited(text, following[1])
        new_words = changed.encode().split()
        same = _same_start(words, new_words)
        known = hashes[: max(0, same - shingle + 1)]
        new = sketch(shingle_hashes(new_words, known, shingle), threshold)
        return (
            doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(found),
            fingerprint(new), likeness(found, new), likeness(found, following[4]), containment(found, new),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, before = None, None
        for batch in batches:
            rows = []
            for doc_id, text, place, guest in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.encode().split()
                hashes = shingle_hashes(words, shingle=shingle)
                doc = (doc_id, text, words, hashes, sketch(hashes, threshold))
                if before is not None and place == bucket:
                    rows.append(describe(before, doc))
                bucket, before = place, None if guest else doc
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
            )

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(c, pa.float64()) for c in ("near_edited", "near_next", "in_edited")]
    )
    placed = _in_buckets(docs).repartition(partitions_of(docs), "bucket")
    ordered = placed.sortWithinPartitions("bucket", "guest", F.col("key").desc(), "text")
    return ordered.select("doc_id", "text", "bucket", "guest").mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, in_edited double",
    )
