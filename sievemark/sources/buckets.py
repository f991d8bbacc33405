"""Keyed tables laid out in buckets, and merges that rewrite only the buckets they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.jobs.resumable import read_done
from sievemark.operators.dedup import keep_first
from sievemark.operators.sets import replaced
from sievemark.session import materialize

BUCKET = "key_bucket"


def bucket_of(keys: Sequence[str], n_buckets: int) -> Column:
    """Bucket of a row; null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    # Even files: large buckets in several tasks, small ones together.
    dealt = rows.hint("rebalance", BUCKET)
    dealt.write.partitionBy(BUCKET).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], n_buckets: int) -> None:
    """Write ``df`` to the new folder ``path``, one folder per bucket of its keys.

    Sized so that a bucket is what a merge may rewrite for one new row, say 1 GB."""
    if BUCKET in df.columns:
        raise ValueError(f"The column {BUCKET} is in use")
    _write(df.withColumn(BUCKET, bucket_of(keys, n_buckets)), path, "error")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table, without its buckets."""
    return spark.read.parquet(path).drop(BUCKET)


def touched_rows(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame:
    """Rows of some buckets; Spark reads their folders only."""
    return spark.read.parquet(path).where(F.col(BUCKET).isin(*buckets))


def merge_bucketed(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    n_buckets: int,
    *,
    order: Sequence[str | Column] | None = None,
    commit: int | str | None = None,
) -> list[int]:
    """Upsert ``new`` into the table at ``path`` and return the buckets that were rewritten.

    Of several new rows of a key the first by ``order`` counts, by default by all columns from left
    to right; null keys are equal. Only buckets that hold a new key are read and replaced, files of
    all others stay as they are. Without new rows nothing is written. The table must have been
    written with the same ``keys`` and ``n_buckets``; it may be missing, then it is made.

    The new content of touched buckets is written beside the table first. With ``commit``, it has
    a place of its own there: a call that was cut off while it replaced buckets is finished from
    that place by the next call with the same ``commit``, and one that was done does nothing
    anew, so replays neither lose nor repeat rows. Commits must come one after the other.
    """
    if BUCKET in new.columns:
        raise ValueError(f"The column {BUCKET} is in use")
    if commit is None:
        staged = materialize(_merged(spark, path, new, keys, n_buckets, order), "merged")
    else:
        root = f"{path.rstrip('/')}/_merges/{commit}"
        if _marked(spark, f"{root}.done"):
            return []
        if not _marked(spark, f"{root}.staged"):
            _merged(spark, path, new, keys, n_buckets, order).write.mode("overwrite").parquet(root)
            _mark(spark, f"{root}.staged")
        staged = spark.read.parquet(root)
    # At most n_buckets numbers.
    buckets = sorted(r[0] for r in staged.select(BUCKET).distinct().collect())
    if buckets:
        _write(staged, path, "overwrite")
    if commit is not None:
        _mark(spark, f"{root}.done")
    return buckets


def _merged(spark, path, new, keys, n_buckets, order) -> DataFrame:
    """The new content of the buckets that ``new`` touches."""
    order = new.columns if order is None else order
    keyed = keep_first(new, keys, order).withColumn(BUCKET, bucket_of(keys, n_buckets))
    first = materialize(keyed, "merge")
    buckets = sorted(r[0] for r in first.select(BUCKET).distinct().collect())
    table = read_done(spark, path)
    if table is None or not buckets:
        return first
    extra = {c.lower() for c in first.columns} - {c.lower() for c in table.columns}
    if extra:
        raise ValueError(f"{path} has no column {', '.join(sorted(extra))}")
    kept = replaced(touched_rows(spark, path, buckets), first, keys)
    return kept.unionByName(first, allowMissingColumns=True)


def _mark(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)


def _marked(spark: SparkSession, path: str) -> bool:
    found = read_done(spark, path)
    return found is not None and bool(found.take(1))
