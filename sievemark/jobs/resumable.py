"""Run a transformation over the rows that are not done yet, slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from sievemark.operators.joins import pending_rows
from sievemark.session import scratch_path

ModelFunction = Callable[[list[str]], Sequence[Any]]
Answer = tuple[Any, str | None]

# Why a row has no value; null where it has one.
ERROR = "error"

# Bytes of text that a task takes out of an Arrow batch at once; a longer text is alone.
CALL_BYTES = 2 << 20


def call_model(fn: ModelFunction, texts: list[str], retries: int = 2) -> list[Answer]:
    """(answer, error) of each text in order; the error is None where ``fn`` answered.

    A batch that keeps failing is tried text by text, so one bad text costs only its
    own answer.
    """
    if not texts:
        return []
    problem = ""
    for _ in range(retries + 1):
        try:
            answers = list(fn(texts))
            if len(answers) == len(texts):
                return [(a, None if a is not None else "no answer") for a in answers]
            problem = f"{len(answers)} answers for {len(texts)} texts"
        except Exception as e:  # the user function may raise anything
            problem = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(None, problem)]
    return [call_model(fn, [t], retries)[0] for t in texts]


def call_in_batches(
    fn: ModelFunction, texts: list[str], retries: int, batch_size: int | None
) -> list[Answer]:
    """``call_model`` with at most ``batch_size`` texts per call."""
    step = batch_size or max(len(texts), 1)
    return [a for i in range(0, len(texts), step) for a in call_model(fn, texts[i : i + step], retries)]


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` (id, then texts) in slices of rows with about ``CALL_BYTES`` of text."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[1:]:
        sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + CALL_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def map_columns(
    df: DataFrame,
    id_col: str,
    text_cols: Sequence[str],
    fn: ModelFunction,
    fields: Sequence[StructField],
    retries: int = 2,
    batch_size: int | None = None,
) -> DataFrame:
    """(id, one field per text column, error) with ``fn`` applied to every text column; only id and
    texts travel to Python. Without ``batch_size`` a call gets at most one Arrow batch and about
    ``CALL_BYTES`` of text. A row is in error if one of its calls failed."""
    out = StructType([df.schema[id_col], *fields, StructField(ERROR, StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                columns, errors = [rows.column(0).cast(schema.field(0).type)], [None] * rows.num_rows
                for i, texts in enumerate(rows.columns[1:], 1):
                    answers = call_in_batches(fn, texts.to_pylist(), retries, batch_size)
                    values = pd.Series([a for a, _ in answers])
                    columns.append(pa.Array.from_pandas(values, type=schema.field(i).type))
                    errors = [old or new for old, (_, new) in zip(errors, answers)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], schema=schema)

    return df.select(id_col, *[F.col(c).cast("string") for c in text_cols]).mapInArrow(run, out)


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: ModelFunction,
    out_type: str,
    retries: int = 2,
    batch_size: int | None = None,
) -> DataFrame:
    """(id, value, error) with ``fn`` applied to batches of texts, as ``map_columns`` does."""
    value = StructType.fromDDL(f"value {out_type}")["value"]
    return map_columns(df, id_col, [text_col], fn, [value], retries, batch_size)


def read_done(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there. Other errors come out."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def errors_path(path: str) -> str:
    """Where failed rows of a job are listed; readers of ``path`` skip such a folder."""
    return f"{path.rstrip('/')}/_errors"


def open_failures(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(id, errors) of rows that failed in some run into ``path`` and are still not done.

    One row per id with its distinct reasons, sorted. Empty if nothing ever failed; a row that a
    later run has answered is listed no more, though its line stays in the files.
    """
    failed, done = read_done(spark, errors_path(path)), read_done(spark, path)
    if failed is None:
        if done is None:
            raise ValueError(f"No job has written to {path}")
        id_type = done.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {id_type}, errors array<string>")
    pending = failed if done is None else pending_rows(failed, done, id_col)
    return pending.groupBy(id_col).agg(F.sort_array(F.collect_set(ERROR)).alias("errors"))


def run_resumable(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    id_col: str,
    n_slices: int = 1,
) -> DataFrame:
    """Append ``transform(pending rows)`` to ``path`` and return the whole table.

    ``transform`` may add an ``error`` column. Rows with an error are not stored as done:
    they are listed below ``errors_path(path)`` and stay pending, so the next run tries them
    again. A slice all of whose rows fail raises.

    The source is read once. With more than one slice its pending rows are first written
    by slice, and each slice is one committed write of its own.
    """
    spark = source.sparkSession
    done = read_done(spark, path)
    todo = source if done is None else pending_rows(source, done, id_col)
    if n_slices == 1:
        _append(spark, transform(todo), path)
        return spark.read.parquet(path)
    parts = scratch_path(spark, "pending")
    slice_of = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slices)).cast("int")
    todo.withColumn("slice", slice_of).write.partitionBy("slice").parquet(parts)
    schema = todo.withColumn("slice", slice_of).schema
    for i in range(n_slices):
        part = spark.read.schema(schema).parquet(parts).where(F.col("slice") == i).drop("slice")
        _append(spark, transform(part), path)
    return spark.read.parquet(path)


def _append(spark: SparkSession, result: DataFrame, path: str) -> None:
    if ERROR not in result.columns:
        result.write.mode("append").parquet(path)
        return
    stage = scratch_path(spark, "answers")  # so that the model runs once
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count(ERROR).alias("failed")]
    result.observe(seen, *counts).write.parquet(stage)
    answers = spark.read.schema(result.schema).parquet(stage)
    failed = answers.where(F.col(ERROR).isNotNull())
    good = answers.where(F.col(ERROR).isNull())
    n_failed = seen.get["failed"]
    n_good = seen.get["rows"] - n_failed
    if n_failed:
        failed.select(answers.columns[0], ERROR).write.mode("append").parquet(errors_path(path))
    if n_failed and not n_good:
        raise RuntimeError(f"All {n_failed} rows failed; first: {failed.first()[ERROR]}")
    good.drop(ERROR).write.mode("append").parquet(path)
