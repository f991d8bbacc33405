"""Compare models by how well cosine search finds each category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.constants import COMPARISON_KS
from sievemark.operators.metrics import retrieval_metrics
from sievemark.operators.topk import cosine_topk
from sievemark.session import materialize


def search_models(
    models: Mapping[str, tuple[DataFrame, DataFrame]], k: int, *, id_col: str
) -> tuple[DataFrame, DataFrame]:
    """Search every category once per model.

    ``models``: name -> (corpus with id and embedding, queries with category and
    embedding). Returns the hits, written to the shared folder because every measure
    reads them again, and the (model, category) pairs searched.
    """
    hits, searches = [], []
    for name, (corpus, queries) in models.items():
        found = cosine_topk(corpus, queries, k, id_col=id_col, query_cols=["category"])
        hits.append(found.withColumn("model", F.lit(name)))
        searches.append(queries.select(F.lit(name).alias("model"), "category"))
    stored = materialize(reduce(DataFrame.unionByName, hits), "hits")
    return stored, reduce(DataFrame.unionByName, searches)


def compare_models(
    models: Mapping[str, tuple[DataFrame, DataFrame]],
    truth: DataFrame,
    ks: Sequence[int] = COMPARISON_KS,
    *,
    id_col: str,
) -> DataFrame:
    """Metrics of all models, categories and depths in one job."""
    hits, searches = search_models(models, max(ks), id_col=id_col)
    return retrieval_metrics(hits, truth, searches, ks, id_col=id_col, max_hits=hits.count())
