"""Keep a keyed table current while files arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sievemark.sources.buckets import merge_bucketed


def upsert_new_files(
    spark: SparkSession,
    in_path: str,
    schema: StructType,
    table_path: str,
    checkpoint_path: str,
    keys: Sequence[str],
    n_buckets: int,
    *,
    order: Sequence[str] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Merge all files not seen yet into the bucketed table at ``table_path``, then stop.

    Rows of later batches replace earlier ones of the same key, so late updates of known ids win;
    within a batch the first by ``order`` counts. A batch rewrites only the buckets of its keys.
    Batches are committed by their number, which a restart from ``checkpoint_path`` repeats, so a
    batch that is replayed after a failure leaves the table as one run of it does. A table must
    always be fed from the same checkpoint.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        rows = batch if transform is None else transform(batch)
        merge_bucketed(spark, table_path, rows, keys, n_buckets, order=order, commit=number)

    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(in_path)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
