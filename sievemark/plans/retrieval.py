"""Search postings by text, reusing stored query vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.constants import DIM_MODEL_SLOTS
from sievemark.jobs.encode import encode_texts
from sievemark.jobs.resumable import ERROR, ModelFunction
from sievemark.operators.joins import query_vector_lookup, with_metadata
from sievemark.operators.topk import cosine_topk
from sievemark.session import materialize


def resolve_query_vectors(
    requests: DataFrame,
    stored_queries: DataFrame,
    stored_vectors: DataFrame,
    encode_fn: ModelFunction,
    slots: Mapping[int, tuple[str, str]] = DIM_MODEL_SLOTS,
) -> DataFrame:
    """Requests with an ``embedding``: the stored one or else a fresh one.

    A request that cannot be encoded stops the job, so that none goes unanswered."""
    looked_up = query_vector_lookup(requests, stored_queries, stored_vectors, slots)
    fresh = encode_texts(
        looked_up.where("needs_encoding"), encode_fn, "request_id", "query_text"
    )
    problem = F.concat(
        F.lit("No vector for request "), F.col("request_id").cast("string"), F.lit(": "),
        F.coalesce(ERROR, F.lit("not encoded")),
    )
    return (
        looked_up.join(fresh, "request_id", "left")
        .withColumn(
            "embedding",
            F.coalesce(
                F.col("vector").cast("array<double>"), "embedding",
                F.raise_error(problem).cast("array<double>"),
            ),
        )
        .drop(ERROR)
    )


def retrieve_by_text(
    requests: DataFrame,
    corpus: DataFrame,
    postings: DataFrame,
    stored_queries: DataFrame,
    stored_vectors: DataFrame,
    encode_fn: ModelFunction,
    k: int = 10,
    *,
    id_col: str,
    slots: Mapping[int, tuple[str, str]] = DIM_MODEL_SLOTS,
) -> DataFrame:
    """Posting rows for each request in rank order, with the score."""
    queries = resolve_query_vectors(requests, stored_queries, stored_vectors, encode_fn, slots)
    # Stored, because it is read more than once and the model should run once.
    queries = materialize(queries.select("request_id", "embedding"), "query-vectors")
    corpus = corpus.select(id_col, "embedding")
    hits = cosine_topk(corpus, queries, k, id_col=id_col, query_cols=["request_id"])
    return with_metadata(hits, postings, id_col, max_hits=queries.count() * k)
