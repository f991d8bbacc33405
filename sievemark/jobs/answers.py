"""Model answers by content: one call per distinct text, however many rows have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import unused
from sievemark.jobs.resumable import ModelFunction, map_texts, run_resumable
from sievemark.operators.joins import broadcast_if_bounded

KEY = "prompt_key"


def prompt_key(model: str, prompt: Column) -> Column:
    """SHA-256 of model and prompt; a null prompt is the empty one."""
    text = F.coalesce(prompt.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}:"), text), 256)


def answer_distinct(
    df: DataFrame,
    prompt_col: str,
    fn: ModelFunction,
    path: str,
    *,
    model: str,
    out_type: str = "string",
    answer_col: str = "answer",
    retries: int = 2,
    batch_size: int | None = None,
    n_slices: int = 1,
) -> DataFrame:
    """``df`` with the answer of ``fn`` to each prompt.

    Answers are kept at ``path`` under the digest of model and prompt. Only prompts that have none
    there are asked, each once, so equal texts cost one call over all runs and tables that use the
    path. Copies are dropped before prompts are moved: every task keeps one row per digest, so a
    prompt that a third of the rows share is a row per task. A call that fails is listed below
    ``path`` with its reason, its rows have a null answer, and the next run asks again.

    Rows stay as they are, repeated ones and those with null or empty prompts too; a column called
    ``answer_col`` is replaced. An empty table asks nothing.
    """
    (key,) = unused([*df.columns, answer_col], KEY)
    keyed = df.drop(answer_col).withColumn(key, prompt_key(model, F.col(prompt_col)))
    text = F.coalesce(F.col(prompt_col).cast("string"), F.lit(""))
    asked = keyed.select(F.col(key).alias(KEY), text.alias("prompt")).groupBy(KEY).agg(F.first("prompt").alias("prompt"))

    def ask(pending: DataFrame) -> DataFrame:
        return map_texts(pending, KEY, "prompt", fn, out_type, retries, batch_size)

    answers = run_resumable(asked, ask, path, KEY, n_slices)
    answers = answers.select(F.col(KEY).alias(f"{key}_"), F.col("value").alias(answer_col))
    answers = broadcast_if_bounded(answers, answers.count())
    return keyed.join(answers, F.col(key) == F.col(f"{key}_"), "left").drop(key, f"{key}_")
