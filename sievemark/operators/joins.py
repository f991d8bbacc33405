"""Label joins, pending rows, category pairs and stored query vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.constants import DIM_MODEL_SLOTS, MODEL_CATEGORIES
from sievemark.functions.names import same_model
from sievemark.functions.strings import strip_equals
from sievemark.functions.vectors import slot_for_dim

# Narrow rows that may be sent to every executor when a caller states an upper bound.
BROADCAST_ROWS = 100_000
# Rows with a vector of up to 4096 doubles each, so 64 MB at most.
BROADCAST_VECTORS = 2_000


def broadcast_if_bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast only for a side whose stated row bound is small."""
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROWS else df


def count_single_rows(df: DataFrame, keys: Sequence[str], what: str) -> int:
    """Rows of ``df`` with all ``keys`` set. Raises if two of them have equal keys."""
    copies = df.dropna(subset=list(keys)).groupBy(*keys).count()
    rows, most = copies.agg(F.sum("count"), F.max_by(F.struct(*keys, "count"), "count")).first()
    if most is not None and most["count"] > 1:
        raise ValueError(f"{what} occurs {most['count']} times: {[most[k] for k in keys]}")
    return rows or 0


def labels_left_join(postings: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Every posting, with null labels where there are none."""
    return postings.join(labels, id_col, "left")


def pending_rows(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in ``done``."""
    return df.join(done.select(id_col), id_col, "left_anti")


def category_dim(
    spark: SparkSession, categories: Mapping[str, str] = MODEL_CATEGORIES
) -> DataFrame:
    """(category, description): a handful of rows from configuration."""
    return spark.createDataFrame(list(categories.items()), "category string, description string")


def with_category_description(
    df: DataFrame, categories: Mapping[str, str] = MODEL_CATEGORIES
) -> DataFrame:
    return df.join(F.broadcast(category_dim(df.sparkSession, categories)), "category", "left")


def posting_category_pairs(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per (posting, category), unfolded in place without a join."""
    return df.withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))


def pairs_to_wide(
    pairs: DataFrame, id_col: str, categories: Sequence[str], label_col: str = "label"
) -> DataFrame:
    """Answers per (id, category) back to one 0/1 column per category."""
    answers = [
        F.coalesce(F.max(F.when(F.col("category") == c, F.col(label_col))), F.lit(0)).alias(c)
        for c in categories
    ]
    return pairs.groupBy(id_col).agg(*answers)


def with_metadata(
    hits: DataFrame, postings: DataFrame, id_col: str, max_hits: int | None = None
) -> DataFrame:
    """Posting columns for each hit, null where there is no such posting.

    The few hits go to the postings, not the reverse. A posting id that occurs twice would
    multiply hits, so it stops the job.
    """
    wanted = broadcast_if_bounded(hits.select(id_col).distinct(), max_hits)
    found = postings.join(wanted, id_col, "left_semi")
    copies = F.count("*").over(Window.partitionBy(id_col))
    twice = F.raise_error(F.concat(F.lit("Posting id occurs more than once: "), F.col(id_col).cast("string")))
    unique = found.withColumn("copies", copies).withColumn(
        id_col, F.when(F.col("copies") == 1, F.col(id_col)).otherwise(twice.cast(found.schema[id_col].dataType))
    )
    return hits.join(broadcast_if_bounded(unique.drop("copies"), max_hits), id_col, "left")


def query_vector_lookup(
    requests: DataFrame,
    stored_queries: DataFrame,
    stored_vectors: DataFrame,
    slots: Mapping[int, tuple[str, str]] = DIM_MODEL_SLOTS,
) -> DataFrame:
    """Stored vector of each request, or ``needs_encoding``.

    ``requests``: request_id, category, query_text, dim. ``stored_queries``: category,
    query. ``stored_vectors``: category, slot, model_name, vector. A vector is reused
    only if the category is known, the stored query equals the text after strip, the
    slot of this width is filled by the expected model and the width is right. A category
    with two stored queries, or two vectors for a slot, would multiply requests and raises;
    rows without a category answer none. The stored tables are counted for this, and
    broadcast if they are small.
    """
    n_queries = count_single_rows(stored_queries, ["category"], "Stored query")
    n_vectors = count_single_rows(stored_vectors, ["category", "slot"], "Stored vector")
    slot, model = slot_for_dim(F.col("dim"), slots)
    asked = requests.withColumn("slot", slot).withColumn("expected_model", model)
    known = stored_queries.select(F.col("category").alias("known_category"), "query")
    vectors = stored_vectors.select(
        F.col("category").alias("vector_category"), F.col("slot").alias("vector_slot"), "model_name", "vector"
    )
    same_text = (F.col("category") == F.col("known_category")) & strip_equals(
        F.col("query"), F.col("query_text")
    )
    usable = (
        (F.col("known_category") == F.col("vector_category"))
        & (F.col("slot") == F.col("vector_slot"))
        & same_model(F.col("model_name"), F.col("expected_model"))
        & (F.size("vector") == F.col("dim"))
        & (F.size("vector") > 0)
    )
    known = broadcast_if_bounded(known.dropna(subset=["known_category"]), n_queries)
    vectors = vectors.dropna(subset=["vector_category", "vector_slot"])
    if n_vectors <= BROADCAST_VECTORS:
        vectors = F.broadcast(vectors)
    return (
        asked.join(known, same_text, "left")
        .join(vectors, usable, "left")
        .select(*asked.columns, "vector")
        .withColumn("needs_encoding", F.col("vector").isNull())
    )
