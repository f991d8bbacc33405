"""Seeded order, global row positions, slices and batches.

The order key is an MD5 hash, so its leading hex digits split any table into even
buckets. A row's global position is its bucket's offset plus its place inside the
bucket. No step sorts or numbers the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.constants import SHUFFLE_SEED
from sievemark.functions.names import unused
from sievemark.functions.strings import empty_if_null

ORDER_COL = "order_key"
BUCKET_DIGITS = 4  # at most 16**4 offset rows, which is what gets broadcast


def order_key(id_col: str, seed: int = SHUFFLE_SEED) -> Column:
    """Pseudo-random but fixed order of ids; ties (equal ids) are equal rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), empty_if_null(F.col(id_col).cast("string"))))


def with_order_key(df: DataFrame, id_col: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """``df`` with the order key as a column of that name, which a caller may order by."""
    return df.withColumn(ORDER_COL, order_key(id_col, seed))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """All rows in seeded order (a distributed range sort)."""
    (key,) = unused(df.columns, ORDER_COL)
    return df.withColumn(key, order_key(id_col, seed)).orderBy(key, id_col).drop(key)


def _bucket_offsets(buckets: DataFrame) -> DataFrame:
    """(bucket, n_rows, offset, n_total): at most 16**BUCKET_DIGITS rows."""
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n_rows"))
    # One task, but over bucket counts only, whose number is fixed.
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "bucket",
        "n_rows",
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"),
        F.sum("n_rows").over(everything).alias("n_total"),
    )


def with_position(
    df: DataFrame,
    id_col: str,
    seed: int = SHUFFLE_SEED,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Add ``position`` (0-based place in seeded order) and ``n_total``.

    With ``start``/``end`` only rows in ``[start, end)`` come back, and buckets wholly
    outside are dropped before the shuffle. Reads ``df`` twice, the first time for
    ids only, so hand it a stored table and not a long plan. Ids must be unique
    (``dedup.duplicate_ids`` checks that): rows of one id have no order among them. Columns of
    ``df`` that have the two names are replaced, all others stay.
    """
    key, bucket, counted, offset = unused(df.columns, ORDER_COL, "bucket", "counted", "offset")
    keyed = df.drop("position", "n_total").withColumn(key, order_key(id_col, seed))
    keyed = keyed.withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS))
    offsets = _bucket_offsets(keyed.select(F.col(bucket).alias("bucket")))
    if start is not None:
        offsets = offsets.where(F.col("offset") + F.col("n_rows") > start)
    if end is not None:
        offsets = offsets.where(F.col("offset") < end)
    offsets = offsets.select(F.col("bucket").alias(counted), F.col("offset").alias(offset), "n_total")
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(key, id_col))
    out = keyed.join(F.broadcast(offsets), F.col(bucket) == F.col(counted))
    out = out.withColumn("position", F.col(offset) + place - 1)
    if start is not None:
        out = out.where(F.col("position") >= start)
    if end is not None:
        out = out.where(F.col("position") < end)
    rest = [c for c in df.columns if c.lower() not in ("position", "n_total")]
    return out.select(*[F.col(f"`{c}`") for c in rest], "n_total", "position")


def slice_rows(
    df: DataFrame, id_col: str, start: int, end: int, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Rows ``[start, end)`` of the seeded order."""
    return with_position(df, id_col, seed, start, end).drop("n_total")


def first_rows(df: DataFrame, id_col: str, n: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """First ``n`` rows of the seeded order, in that order.

    One pass: each task keeps its first ``n`` rows and the driver's plan merges those."""
    (key,) = unused(df.columns, ORDER_COL)
    return df.withColumn(key, order_key(id_col, seed)).orderBy(key, id_col).limit(n).drop(key)


def with_batch(df: DataFrame, id_col: str, size: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Add ``position``, ``batch`` (0-based) and ``n_batches`` for batches of ``size``."""
    return (
        with_position(df, id_col, seed)
        .withColumn("batch", F.floor(F.col("position") / size))
        .withColumn("n_batches", F.ceil(F.col("n_total") / size))
        .drop("n_total")
    )
