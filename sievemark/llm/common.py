"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.session import materialize

# A table of fixed-width rows up to this count is broadcast (about 12 MB at 40 bytes).
BROADCAST_ROWS = 300_000


def text_or_empty(name: str = "text") -> Column:
    """The column, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_digest() -> Column:
    """SHA-256 of the text, with null as the empty text."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def small_side(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``stored``, a table of narrow fixed-width rows read from files, marked for broadcast
    only if it was counted to hold at most ``limit`` rows. Beyond that Spark shuffles."""
    return F.broadcast(stored) if stored.count() <= limit else stored


def partitions_of(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` in the order of ``keys`` over range partitions, written and read back, with ``run``
    (the number of the partition) and ``place`` (0-based place in it).

    Equal keys may be dealt to several partitions, so a key that very many rows share is no task
    of its own. Bounds come from a sample that Spark takes, and only bounds depend on it; as the
    table is written, a lost executor cannot change them. ``df`` is read twice, so hand in a
    stored table.
    """
    number = F.monotonically_increasing_id()
    dealt = (
        df.withColumn("run", number)  # tells equal keys apart, replaced below
        .repartitionByRange(partitions_of(df), *keys, "run")
        .sortWithinPartitions(*keys)
        .withColumn("place", number)
    )
    run = F.shiftright("place", 33).cast("int")
    return materialize(
        dealt.withColumn("run", run).withColumn("place", F.col("place").bitwiseAND(2**33 - 1)), name
    )
