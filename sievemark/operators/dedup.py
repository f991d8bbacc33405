"""Keep the first row of each group of equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.names import unused


def key_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the key columns; null differs from '' and parts cannot run together."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        parts.append(
            F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.sha2(F.concat(*parts), 256)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order; nulls are equal to each other.

    Spark limits each key to one row per map task before the exchange (the row number
    filter becomes a group limit), so a key held by a third of the table still sends
    only one row per task. The keys travel as a fixed-size hash.
    """
    hashed, place = unused(df.columns, "key_hash", "place")
    first = Window.partitionBy(hashed).orderBy(*order)
    return (
        df.withColumn(hashed, key_hash(keys))
        .withColumn(place, F.row_number().over(first))
        .where(F.col(place) == 1)
        .drop(hashed, place)
    )


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that occur more than once, with their count; empty when ids are unique."""
    return df.groupBy(id_col).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
