"""Recall, precision, F1 and NDCG at several depths from one search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.constants import COMPARISON_KS
from sievemark.operators.joins import broadcast_if_bounded

GROUP_COLS = ["model", "category"]


def flag_hits(
    hits: DataFrame, truth: DataFrame, on: Sequence[str], max_hits: int | None = None
) -> DataFrame:
    """Add ``correct_output``: is the hit in the truth table?

    The hits go to the truth rows first and only matching truth rows come back, so a
    large truth table is scanned where it lies.
    """
    on = list(on)
    wanted = hits.select(*on).distinct()
    found = (
        truth.select(*on)
        .join(broadcast_if_bounded(wanted, max_hits), on, "left_semi")
        .distinct()
        .withColumn("found", F.lit(True))
    )
    return (
        hits.join(broadcast_if_bounded(found, max_hits), on, "left")
        .withColumn("correct_output", F.coalesce("found", F.lit(False)))
        .drop("found")
    )


def match_totals(flagged: DataFrame, group_cols: Sequence[str] = GROUP_COLS) -> DataFrame:
    """Hits and true matches of each search."""
    return flagged.groupBy(*group_cols).agg(
        F.count("*").alias("n_retrieved"),
        F.sum(F.col("correct_output").cast("long")).alias("n_true"),
    )


def truth_sizes(truth: DataFrame, id_col: str, category_col: str = "category") -> DataFrame:
    """Distinct truth ids per category (spread over ids first, so no hot category)."""
    return truth.groupBy(category_col).agg(F.count_distinct(id_col).alias("n_truth"))


def with_gains(flagged: DataFrame, group_cols: Sequence[str] = GROUP_COLS) -> DataFrame:
    """Add ``rel``, ``gain`` (mean relevance of equal scores) and ``ideal_rank``.

    Scores are compared as 32-bit floats. The ideal order is made of the retrieved
    rows only. Groups hold one search's hits, so they are at most max k rows long.
    """
    tied = Window.partitionBy(*group_cols, F.col("score").cast("float"))
    ideal = Window.partitionBy(*group_cols).orderBy(F.col("rel").desc(), F.col("rank"))
    return (
        flagged.withColumn("rel", F.col("correct_output").cast("int"))
        .withColumn("gain", F.avg("rel").over(tied))
        .withColumn("ideal_rank", F.row_number().over(ideal))
    )


def retrieval_metrics(
    hits: DataFrame,
    truth: DataFrame,
    searches: DataFrame,
    ks: Sequence[int] = COMPARISON_KS,
    *,
    id_col: str,
    max_hits: int | None = None,
) -> DataFrame:
    """(model, category, k, n_hits, recall, precision, f1, ndcg), all k from one search.

    ``hits``: model, category, rank, id, score. ``truth``: category, id. ``searches``:
    the (model, category) pairs to report, also those without hits. Precision divides
    by k even if fewer rows came back; NDCG looks at the list of length max k.
    """
    depths = F.explode(F.array(*[F.lit(int(k)) for k in ks]))
    listed = hits.where(F.col("rank") <= max(ks))
    flagged = flag_hits(listed, truth, ["category", id_col], max_hits)
    per_k = with_gains(flagged).withColumn("k", depths)

    def within(rank: str, value: str):
        discounted = F.col(value) / F.log2(F.col(rank) + F.lit(1.0))
        return F.sum(F.when(F.col(rank) <= F.col("k"), discounted).otherwise(0.0))

    sums = per_k.groupBy(*GROUP_COLS, "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel")).otherwise(0)).alias("n_hits"),
        within("rank", "gain").alias("dcg"),
        within("ideal_rank", "rel").alias("idcg"),
    )
    n_hits, n_truth = F.col("n_hits"), F.col("n_truth")
    p, r = F.col("precision"), F.col("recall")
    return (
        searches.select(*GROUP_COLS)
        .withColumn("k", depths)
        .join(sums, [*GROUP_COLS, "k"], "left")
        .join(truth_sizes(truth, id_col), "category", "left")
        .withColumn("n_hits", F.coalesce(n_hits, F.lit(0)))
        .withColumn("recall", F.when(n_truth > 0, n_hits / n_truth).otherwise(0.0))
        .withColumn("precision", F.when(F.col("k") > 0, n_hits / F.col("k")).otherwise(0.0))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
        .withColumn(
            "ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
        )
        .select(*GROUP_COLS, "k", "n_hits", "recall", "precision", "f1", "ndcg")
    )


def metrics_wide(metrics: DataFrame, ks: Sequence[int] = COMPARISON_KS) -> DataFrame:
    """One row per (model, category): Recall@k, Precision@k, F1@k, NDCG@k for each k."""
    names = {"Recall": "recall", "Precision": "precision", "F1": "f1", "NDCG": "ndcg"}
    wide = (
        metrics.groupBy(*GROUP_COLS)
        .pivot("k", [int(k) for k in ks])
        .agg(*[F.first(col).alias(name) for name, col in names.items()])
    )
    ordered = [F.col(f"{k}_{name}").alias(f"{name}@{k}") for k in ks for name in names]
    return wide.select(*GROUP_COLS, *ordered)
