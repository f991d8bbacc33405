"""Write cleaned tables, category subsets, manifests and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sievemark.constants import POSTING_COLUMNS
from sievemark.operators.filters import select_existing
from sievemark.operators.joins import broadcast_if_bounded
from sievemark.operators.labels import category_counts, chunked_ids, stored_ids
from sievemark.session import materialize


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_csv`` gives back with its newlines, quotes and outer spaces.

    CSV has no null: null and '' both come back as null.
    """
    (
        df.write.options(header="true", quote='"', escape='"', quoteAll="true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def write_subsets(
    subsets: DataFrame,
    path: str,
    columns: Sequence[str] = POSTING_COLUMNS,
    fmt: str = "parquet",
) -> None:
    """One folder per category with the columns that exist.

    Rows are written where they are: gathering a category first would put the largest
    one into a single task.
    """
    chosen = select_existing(subsets, [*[c for c in columns if c != "category"], "category"])
    writer = chosen.write.partitionBy("category")
    if fmt == "csv":
        writer = writer.options(header="true", quote='"', escape='"', quoteAll="true")
    writer.format(fmt).save(path)


def manifest(
    subsets: DataFrame,
    categories: DataFrame,
    id_col: str,
    *,
    source: str,
    method: str,
    preprocessing: dict[str, str],
    generated_at: Column | None = None,
    ids_per_chunk: int = 10_000,
) -> DataFrame:
    """One record per category and chunk of ids: description, count, file, sorted ids.

    ``categories``: category, description. A category without rows has one record
    with count 0 and no ids.
    """
    # Ids are computed once; counts and chunks come from that narrow table.
    ids = stored_ids(subsets, id_col)
    counts = materialize(category_counts(ids, categories), "category-counts")
    chunks = chunked_ids(ids, ids_per_chunk).select("category", "chunk", "ids")
    counts = broadcast_if_bounded(counts, counts.count())
    empty = counts.where("n_rows = 0").select(
        "category",
        F.lit(0).cast("long").alias("chunk"),
        F.array().cast(chunks.schema["ids"].dataType).alias("ids"),
    )
    settings = F.struct(*[F.lit(v).alias(k) for k, v in preprocessing.items()])
    return (
        chunks.unionByName(empty)
        .join(counts, "category")
        .select(
            (F.current_timestamp() if generated_at is None else generated_at).alias(
                "generated_at"
            ),
            F.lit(source).alias("source_dataset"),
            F.lit(method).alias("method"),
            settings.alias("preprocessing"),
            "category",
            "description",
            F.col("n_rows").alias("count"),
            F.concat(F.lit("category="), "category").alias("file"),
            "chunk",
            "ids",
        )
    )


def write_manifest(records: DataFrame, path: str) -> None:
    records.write.json(path)


def write_vectors(
    df: DataFrame,
    path: str,
    vector_col: str | None = None,
    dim: int | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """Write ``df`` to the new folder ``path``, read it back and check it.

    The folder must not exist. Row count, and with ``vector_col`` the number of vectors and
    their width ``dim``, must be those of ``df``, and with ``id_col`` the rows' ids and vectors too:
    a sum of hashes of both sides tells them apart. What is written is counted while it is
    written, so ``df`` is computed once; what is stored is read once.
    """
    counts = [F.count(F.lit(1)).alias("rows")]
    if vector_col is not None:
        wrong = F.sum((F.size(vector_col) != dim).cast("int"))
        counts += [F.count(vector_col).alias("vectors"), F.coalesce(wrong, F.lit(0)).alias("wrong")]
    if id_col is not None:
        row = F.xxhash64(id_col, *([] if vector_col is None else [vector_col]))
        counts.append(F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("checksum"))
    written = Observation()
    df.observe(written, *counts).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    expected, found = written.get, stored.agg(*counts).first().asDict()
    if expected != found or found.get("wrong"):
        raise ValueError(f"{path}: expected {expected} with width {dim}, found {found}")
    return stored
