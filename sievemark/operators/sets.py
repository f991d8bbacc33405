"""Append, upsert and range fill of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import normalize_model_id, same_model, unused
from sievemark.functions.strings import strip_equals
from sievemark.operators.dedup import keep_first
from sievemark.operators.joins import broadcast_if_bounded
from sievemark.session import materialize


def union_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and new rows, columns matched by name."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """New rows replace old rows of the same key, so a rerun adds nothing.

    Null keys are equal to each other. Of several new rows of a key the first by ``order``
    counts, by default by all columns from left to right. The new side is computed once and
    stored, one row per key; if it was counted to be small, its keys go to the old rows, which
    then stay where they are. Each side is read once.
    """
    first = materialize(keep_first(new, keys, new.columns if order is None else order), "upsert")
    return replaced(old, first, keys).unionByName(first, allowMissingColumns=True)


def replaced(old: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``stored``, a table that was written before."""
    known = unused([*old.columns, *stored.columns], *[f"new_{k}" for k in keys])
    new_keys = stored.select(*[F.col(k).alias(n) for k, n in zip(keys, known)])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, known)])
    return old.join(broadcast_if_bounded(new_keys, new_keys.count()), same, "left_anti")


def fill_values(
    master: DataFrame,
    values: DataFrame,
    id_col: str,
    column: str,
    keep_old_on_null: bool = False,
) -> DataFrame:
    """Write ``column`` of ``values`` into the rows of the same id; others stay.

    A null value (a failed computation) is written too unless ``keep_old_on_null``.
    """
    value, in_range = unused(master.columns, "new_value", "in_range")
    new = values.select(id_col, F.col(column).alias(value), F.lit(True).alias(in_range))
    replace = F.col(in_range)
    if keep_old_on_null:
        replace = replace & F.col(value).isNotNull()
    return (
        master.join(new, id_col, "left")
        .withColumn(column, F.when(replace, F.col(value)).otherwise(F.col(column)))
        .drop(value, in_range)
    )


def query_cache_upsert(
    stored_queries: DataFrame, stored_vectors: DataFrame, encoded: DataFrame
) -> DataFrame:
    """Store new query vectors where that is allowed.

    ``encoded``: category, slot, model_name, query_text, vector. A vector is stored
    only if its text equals the category's stored query after strip and the slot is
    free or already owned by the same model. Of several such vectors for a slot the
    first by model name and values is stored.
    """
    owner = stored_vectors.select("category", "slot", F.col("model_name").alias("owner"))
    # Spark broadcasts these two by their size, if at all.
    eligible = (
        encoded.join(stored_queries.select("category", "query"), "category")
        .where(strip_equals(F.col("query"), F.col("query_text")))
        .join(owner, ["category", "slot"], "left")
        .where(
            (normalize_model_id(F.col("owner")) == "")
            | same_model(F.col("owner"), F.col("model_name"))
        )
        .select("category", "slot", "model_name", "vector")
    )
    return upsert(stored_vectors, eligible, ["category", "slot"], ["model_name", "vector"])
