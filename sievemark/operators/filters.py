"""Row filters, lenient and strict projections, completeness counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.strings import is_not_blank
from sievemark.functions.vectors import has_dim


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose text is null, empty or only whitespace."""
    return df.where(is_not_blank(F.col(column)))


def contains_pattern(c: Column, pattern: str) -> Column:
    """Case-insensitive Unicode regex search; null is no match."""
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


def include_exclude(c: Column, include: str, exclude: str | None = None) -> Column:
    hit = contains_pattern(c, include)
    return hit if exclude is None else hit & ~contains_pattern(c, exclude)


def positive_labels(labels: DataFrame, label_col: str = "label") -> DataFrame:
    return labels.where(F.col(label_col) == 1)


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows with a value, rows in total."""
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_present"), "n_total")
        for i, c in enumerate(columns)
    ]
    return df.agg(F.count("*").alias("n_total"), *counts).select(F.inline(F.array(*pairs)))


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The asked-for columns that exist, in the asked-for order."""
    return df.select([c for c in columns if c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The asked-for columns; an absent one is an error that names all absent ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError("Missing required columns: " + ", ".join(missing))
    return df.select(list(columns))


def valid_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    return df.where(has_dim(F.col(column), dim))


def rejected_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows that ``valid_vectors`` drops, with the width found (null for no vector)."""
    return df.where(~has_dim(F.col(column), dim)).withColumn(
        "found_dim", F.when(F.col(column).isNotNull(), F.size(column))
    )
