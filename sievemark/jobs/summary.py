"""Fill a summary column for a range of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.strings import render_replace, strip
from sievemark.jobs.resumable import ERROR, ModelFunction, map_texts
from sievemark.operators.ordering import slice_rows
from sievemark.operators.sets import fill_values
from sievemark.session import materialize

SUMMARY_TEMPLATE = (
    "Summarize the role, the required skills and the tools in plain text.\n"
    "Title: {title}\nDescription: {description}\n"
)


def summarize(
    df: DataFrame,
    fn: ModelFunction,
    id_col: str,
    template: str = SUMMARY_TEMPLATE,
    retries: int = 2,
) -> DataFrame:
    """(id, summary, error) of whole descriptions; the summary is null where the model kept failing."""
    values = {"title": F.col("title"), "description": F.col("description")}
    prompts = df.withColumn("prompt", render_replace(template, values))
    raw = map_texts(prompts, id_col, "prompt", fn, "string", retries)
    return raw.select(id_col, strip(F.col("value")).alias("summary"), ERROR)


def fill_summaries(
    master: DataFrame,
    fn: ModelFunction,
    id_col: str,
    start: int,
    end: int,
    template: str = SUMMARY_TEMPLATE,
    retries: int = 2,
    keep_old_on_null: bool = False,
    errors_to: str | None = None,
) -> DataFrame:
    """Master table with ``summary`` computed for positions ``[start, end)``.

    With ``errors_to`` the summaries are computed at once and stored, and (id, error) of the calls
    that failed replaces what is in that folder; it is empty if none did.
    """
    if "summary" not in master.columns:
        master = master.withColumn("summary", F.lit(None).cast("string"))
    rows = slice_rows(master, id_col, start, end)
    values = summarize(rows, fn, id_col, template, retries)
    if errors_to is not None:
        values = materialize(values, "summaries")
        failed = values.where(F.col(ERROR).isNotNull()).select(id_col, ERROR)
        failed.write.mode("overwrite").parquet(errors_to)
    values = values.drop(ERROR)
    return fill_values(master, values, id_col, "summary", keep_old_on_null)
