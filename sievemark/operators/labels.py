"""Title rules, label matrices and category subsets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark import constants as C
from sievemark.operators.filters import include_exclude
from sievemark.operators.joins import broadcast_if_bounded
from sievemark.session import materialize

# Hash digits of an id's bucket, so at most 4096 buckets in a category.
CHUNK_DIGITS = 3


def _any_of(phrases: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases) + ")"


def any_word(phrases: Sequence[str]) -> str:
    return r"\b" + _any_of(phrases) + r"\b"


@dataclass(frozen=True)
class Rule:
    """Category given by a text that matches ``include`` and not ``exclude``."""

    category: str
    include: str
    exclude: str | None = None

    def matches(self, c: Column) -> Column:
        return include_exclude(c, self.include, self.exclude)


ENTRY_LEVEL = Rule(
    "entry_level",
    _any_of(C.ENTRY_LEVEL_SUBSTRINGS) + "|" + any_word(C.ENTRY_LEVEL_WORDS),
    _any_of(C.ENTRY_LEVEL_EXCLUDED_SUBSTRINGS),
)
DATA_BUSINESS = Rule("data_business_analytics", any_word(C.DATA_BUSINESS_WORDS))
FINANCE = Rule("finance_analytics", any_word(C.FINANCE_WORDS))
MARKETING = Rule("marketing_analytics", any_word(C.MARKETING_WORDS))
TITLE_RULES = (ENTRY_LEVEL, DATA_BUSINESS, FINANCE, MARKETING)


def matching_rows(df: DataFrame, rule: Rule, title_col: str = "title") -> DataFrame:
    return df.where(rule.matches(F.col(title_col)))


def label_by_rules(
    df: DataFrame, rules: Sequence[Rule] = TITLE_RULES, title_col: str = "title"
) -> DataFrame:
    """One row per (posting, matching category); all rules in one scan.

    Any function with this shape (postings in, postings with ``category`` out) can
    stand in for it as a labeller.
    """
    title = F.col(title_col)
    found = F.array(*[F.when(r.matches(title), F.lit(r.category)) for r in rules])
    return df.withColumn("category", F.explode(F.array_compact(found)))


def labels_to_long(labels: DataFrame, id_col: str, categories: Sequence[str]) -> DataFrame:
    """Wide 0/1 columns to (id, category, label)."""
    return labels.unpivot(id_col, list(categories), "category", "label")


def labels_to_subsets(
    postings: DataFrame, labels: DataFrame, id_col: str, categories: Sequence[str]
) -> DataFrame:
    """Postings with their label columns, once per category labelled 1.

    Rows without any positive label belong to no subset, so they are dropped before
    the join; the category rows are unfolded after it, so each text moves once.
    """
    positive = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in categories]))
    wanted = (
        labels.select(id_col, *categories)
        .withColumn("positive", positive)
        .where(F.size("positive") > 0)
    )
    return (
        postings.join(wanted, id_col)
        .withColumn("category", F.explode("positive"))
        .drop("positive")
    )


def category_counts(subsets: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows per category of the category table; empty categories count 0."""
    counts = subsets.groupBy("category").agg(F.count("*").alias("n_rows"))
    return categories.join(counts, "category", "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0))
    )


def category_ids(subsets: DataFrame, id_col: str, ids_per_chunk: int = 10_000) -> DataFrame:
    """Sorted ids per category, in chunks: (category, chunk, n_ids, ids).

    No chunk has more than ``ids_per_chunk`` ids, and all but a category's last have as many. Ids
    are ordered by hash bucket, then id; their place in a category is the number of ids in the
    buckets before theirs, from one small table of counts, plus the place in the bucket. So no
    task gathers a category, and ``subsets`` is computed once. Null categories and ids are left
    out; an id should occur once in a category, repeated ones are listed each time.
    """
    return chunked_ids(stored_ids(subsets, id_col), ids_per_chunk)


def stored_ids(subsets: DataFrame, id_col: str) -> DataFrame:
    """(category, bucket, id) of ``subsets``, computed once and written."""
    bucket = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, CHUNK_DIGITS)
    narrow = subsets.where(F.col("category").isNotNull()).select(
        "category", bucket.alias("bucket"), F.col(id_col).alias("id")
    )
    return materialize(narrow, "category-ids")


def chunked_ids(stored: DataFrame, ids_per_chunk: int) -> DataFrame:
    """``category_ids`` of a table from ``stored_ids``."""
    # At most 16**CHUNK_DIGITS rows per category.
    stored = stored.where(F.col("id").isNotNull())
    counts = stored.groupBy("category", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        counts.select("category", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts"
    )
    place = F.row_number().over(Window.partitionBy("category", "bucket").orderBy("id")) - 1
    placed = stored.withColumn("place", place).join(
        broadcast_if_bounded(starts, starts.count()), ["category", "bucket"]
    )
    chunk = F.floor((F.col("start") + F.col("place")) / ids_per_chunk)
    return (
        placed.groupBy("category", chunk.alias("chunk"))
        .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").cast("int").alias("n_ids"))
        .select("category", "chunk", "ids", "n_ids")
    )
