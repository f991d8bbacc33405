"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import BROADCAST_ROWS
from sievemark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, both long).

    In each round every node moves to its smallest neighbour, edges follow and loops go. Nodes
    that are nobody's smallest neighbour vanish, so a few rounds are enough when ids are spread
    at random, as hashes are. Each round is written to the shared folder; nothing reaches the
    driver but row counts. Tables counted to be small are read by one task, which spares a round
    its shuffles; larger ones are only grouped by minimum or joined, both of which Spark splits,
    so a node with very many edges is no task of its own. An empty table gives an empty result.
    """
    edges, left = _stored(_undirected(edges), "edges")
    roots, _ = _stored(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "roots")
    while left:
        parents = edges.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("child"), F.least("a", "b").alias("parent")
        )
        parents, _ = _stored(parents, "parents")
        moved_roots = roots.join(parents, F.col("root") == F.col("child"), "left").select(
            "node", F.coalesce("parent", "root").alias("root")
        )
        roots, _ = _stored(moved_roots, "roots")
        to = parents.select(F.col("child").alias("b"), F.col("parent").alias("to"))
        moved = (
            edges.join(parents, F.col("a") == F.col("child"))
            .select(F.col("parent").alias("a"), "b")
            .join(to, "b")
            .select("a", F.col("to").alias("b"))
        )
        edges, left = _stored(_undirected(moved), "edges")
    return roots


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written and read back, in one partition if it has few rows, and its row count."""
    stored = materialize(df, name)
    n = stored.count()
    return (stored.coalesce(1) if n <= BROADCAST_ROWS else stored), n


def _undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops."""
    pair = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    kept = edges.where(F.col("a") != F.col("b"))
    return kept.select(F.inline(pair)).distinct()
