"""SimHash near-duplicates by multi-index hashing.

Fingerprints within three bits of each other are linked; linked documents form components.

Equal fingerprints are one node, so copies cost nothing. A pair within three bits has at most one
differing bit in one of its two 32-bit segments: each fingerprint looks up the 33 values of the
radius-1 ball around each of its segments in the table of segment values, and complete distances
are verified. Dense groups would give all their pairs that way, so fingerprints within two bits
are first contracted: both have a common neighbour at one bit, and the at most 65 members of such
a neighbourhood are linked to one of them. The lookup then only serves pairs of different groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.llm.common import small_side, text_digest
from sievemark.llm.components import components
from sievemark.session import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42  # of the shingle hash
BITS, SEGMENT_BITS = 64, 32


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text as a signed 64-bit number; 0 if there are no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(BITS, np.int64)
    for first in range(0, n, 65_536):
        part = slice(first, first + 65_536)
        spans = zip(starts[part].tolist(), ends[part].tolist())
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def _flips(low: int, high: int) -> list[int]:
    """Signed 64-bit masks of the single bits low..high-1."""
    return [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(low, high)]


def _xor_each(value: Column, masks: list[int]) -> Column:
    return F.array(value, *[value.bitwiseXOR(F.lit(m)) for m in masks])


def _near_links(prints: DataFrame) -> DataFrame:
    """Edges that connect every pair of fingerprints within two bits."""
    point = F.explode(_xor_each(F.col("fingerprint"), _flips(0, BITS))).alias("point")
    around = prints.select(point, "fingerprint").groupBy("point")
    members = around.agg(F.collect_list("fingerprint").alias("m")).where(F.size("m") > 1)
    return (
        members.select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _segment_rows(prints: DataFrame, masks: bool) -> DataFrame:
    """(key, fingerprint, group): both segment values, or their radius-1 balls."""
    f = F.col("fingerprint")
    low = f.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned(f, SEGMENT_BITS).bitwiseOR(F.lit(1 << (SEGMENT_BITS + 1)))
    flips = _flips(0, SEGMENT_BITS) if masks else []
    keys = F.concat(_xor_each(low, flips), _xor_each(high, flips))
    return prints.select(F.explode(keys).alias("key"), "fingerprint", "group")


def _far_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges between the groups of ``prints`` (fingerprint, group) within ``max_bits``."""
    probes, table = _segment_rows(prints, True), _segment_rows(prints, False)
    mixed = (
        probes.groupBy("key")
        .agg(F.min("group").alias("least"), F.max("group").alias("most"))
        .where("least <> most")
        .select("key")
    )
    mixed = small_side(materialize(mixed, "mixed-segments"))
    t = table.join(mixed, "key", "left_semi").select(
        "key", F.col("fingerprint").alias("other"), F.col("group").alias("b")
    )
    p = probes.join(mixed, "key", "left_semi").withColumnRenamed("group", "a")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other")))
    pairs = p.join(t, (p["key"] == t["key"]) & (F.col("a") != F.col("b")) & (distance <= max_bits))
    return pairs.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """Fingerprint and component of every document.

    Args:
        docs: ``doc_id``, ``text``; other columns are not read.
        shingle: words of a shingle; a shorter text is one shingle as a whole.
        max_bits: 3; the lookup is built for it.

    Returns:
        doc_id, fingerprint string (16 hex digits), component_id (smallest doc_id that can be
        reached over links, itself included). Null and empty texts have fingerprint zero and link
        like others. Repeated rows stay. A null doc_id is never a component's id unless the
        component has no other. An empty table gives no rows.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the segment lookup finds pairs within 3 bits")
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    prints = found.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    prints = materialize(prints, "distinct-fingerprints")
    near = components(_near_links(prints))
    grouped = materialize(
        prints.join(near, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("group")
        ),
        "near-groups",
    )
    far = components(_far_links(grouped, max_bits))
    final = grouped.join(far, F.col("group") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "group").alias("class")
    )
    least = final.groupBy("class").agg(F.min("least_id").alias("component_id"))
    classes = final.join(least, "class").select(F.col("fingerprint").alias("print"), "component_id")
    classes = materialize(classes, "classes")
    return found.join(classes, F.col("fingerprint") == F.col("print")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: the smallest doc_id, then text digest.

    Rows are told apart by id and text. Rows without doc_id come after all others. Of rows with
    the same id and text one stays. Null and empty texts are a component like others. Columns of
    any name stay; an empty table stays empty.
    """
    gone, again, one = unused(docs.columns, "gone", "again", "one")
    row = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        text_digest().alias("digest"),
    )
    found = materialize(near_duplicates(docs.select(row.alias("doc_id"), "text")), "components")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    lost = small_side(materialize(lost, "duplicate-rows"), 100_000)
    kept = docs.join(lost, row == F.col(gone), "left_anti")
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    twice = materialize(twice.select(F.col("doc_id").alias(again)), "repeated-rows")
    if twice.isEmpty():
        return kept
    same = row == F.col(again)
    return kept.join(twice, same, "left_anti").unionByName(
        kept.join(twice, same, "left_semi").withColumn(one, row).dropDuplicates([one]).drop(one)
    )
