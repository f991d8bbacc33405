"""Clean and label posting files as they arrive, each posting once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sievemark.jobs.resumable import read_done
from sievemark.operators.dedup import keep_first, key_hash
from sievemark.operators.joins import pending_rows


def process_new_files(
    spark: SparkSession,
    in_path: str,
    schema: StructType,
    out_path: str,
    checkpoint_path: str,
    transform: Callable[[DataFrame], DataFrame],
    id_col: str,
) -> StreamingQuery:
    """Process all files not seen yet, then stop (``availableNow``).

    ``transform`` must keep ``id_col``. Ids already written are left out, so a batch
    that is replayed after a failure adds no rows.
    """

    def write_batch(batch: DataFrame, _: int) -> None:
        fresh = keep_first(batch, [id_col], [key_hash(batch.columns)])
        done = read_done(spark, out_path)
        if done is not None:
            fresh = pending_rows(fresh, done, id_col)
        transform(fresh).write.mode("append").parquet(out_path)

    return (
        spark.readStream.schema(schema)
        .parquet(in_path)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
