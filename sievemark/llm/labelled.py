"""Labelled rows to learn from, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.session import materialize

# Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 12_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


def held_out(folds: int, fold_out: int) -> Column:
    """Whether a row is kept out of learning; false for a null id."""
    return F.coalesce(fold(F.col("doc_id"), folds) == fold_out, F.lit(False))


def training_labels(
    labels: DataFrame, label: str, folds: int, fold_out: int, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(labelled_id, label 0/1) of at most ``rows`` labelled rows outside the held-out fold.

    Rows are taken by the hash of their id. Null ids and labels teach nothing; of rows that repeat
    an id the larger label counts. The result is written, and its size is bounded by ``rows``."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out(folds, fold_out))
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    taken = known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)
    return materialize(taken, "training-labels")


def joined(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` that ``taken`` labels. At most SAMPLE_ROWS pairs are broadcast."""
    return rows.join(F.broadcast(taken), F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")
