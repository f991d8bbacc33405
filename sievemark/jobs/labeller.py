"""Label postings with a user-supplied model function."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from sievemark.constants import MODEL_CATEGORIES
from sievemark.functions.responses import exclude_when, parse_binary, parse_multilabel
from sievemark.functions.strings import render_format, truncate_chars
from sievemark.jobs.resumable import ERROR, ModelFunction, map_columns, map_texts, run_resumable

# Label that is switched off where the other one is set.
EXCLUSIVE = ("internship", "entry_level")

MULTILABEL_TEMPLATE = (
    "Decide for each category whether the job belongs to it (1) or not (0).\n"
    "Answer with one JSON object such as {{\"internship\": 0}}.\n"
    "Title: {title}\nDescription: {description}\n"
)
BINARY_TEMPLATE = (
    "Does the job belong to the category {category}? Answer 0 or 1.\n"
    "Title: {title}\nDescription: {description}\n"
)


def with_prompt(
    df: DataFrame,
    template: str,
    title_col: str = "title",
    description_col: str = "description",
    prompt_col: str = "prompt",
    max_chars: int | None = None,
) -> DataFrame:
    """Fill title, description and, if present, category into the template.

    The description goes in whole unless ``max_chars`` says how much of it."""
    description = F.col(description_col)
    values = {
        "title": F.col(title_col),
        "description": description if max_chars is None else truncate_chars(description, max_chars),
    }
    if "category" in df.columns:
        values["category"] = F.col("category")
    return df.withColumn(prompt_col, render_format(template, values))


def apply_exclusion(
    labels: DataFrame, winner: str = EXCLUSIVE[0], loser: str = EXCLUSIVE[1]
) -> DataFrame:
    if winner not in labels.columns or loser not in labels.columns:
        return labels
    return labels.withColumn(loser, exclude_when(F.col(winner), F.col(loser)))


def label_multilabel(
    df: DataFrame,
    fn: ModelFunction,
    id_col: str,
    categories: Sequence[str] | Mapping[str, str] = tuple(MODEL_CATEGORIES),
    template: str = MULTILABEL_TEMPLATE,
    retries: int = 2,
    batch_size: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """One call per row answers all categories; (id, one 0/1 column per category, error).

    An answer without JSON, or without a category, gives 0. A call that failed gives 0 too,
    and an ``error`` that tells it from an answer.
    """
    prompts = with_prompt(df, template, max_chars=max_chars)
    raw = map_texts(prompts, id_col, "prompt", fn, "string", retries, batch_size)
    labels = apply_exclusion(parse_multilabel(raw, "value", list(categories)))
    return labels.select(id_col, *categories, ERROR)


def label_per_category(
    df: DataFrame,
    fn: ModelFunction,
    id_col: str,
    categories: Sequence[str] | Mapping[str, str] = tuple(MODEL_CATEGORIES),
    template: str = BINARY_TEMPLATE,
    retries: int = 2,
    batch_size: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """One call per (row, category) answers "0" or "1"; same result shape.

    All categories of a row are asked in the task that holds it. The labels are independent
    answers, so no exclusion applies here. A row is in error if one of its calls failed.
    """
    names = list(categories)
    prompts = df.select(id_col, "title", "description")
    for i, name in enumerate(names):
        asked = with_prompt(
            prompts.withColumn("category", F.lit(name)), template, prompt_col=f"prompt_{i}",
            max_chars=max_chars,
        )
        prompts = asked.drop("category")

    fields = [StructField(f"answer_{i}", StringType()) for i in range(len(names))]
    answers = map_columns(prompts, id_col, [f"prompt_{i}" for i in range(len(names))], fn, fields, retries, batch_size)
    labels = [
        F.coalesce(parse_binary(F.col(f"answer_{i}")), F.lit(0)).alias(n) for i, n in enumerate(names)
    ]
    return answers.select(id_col, *labels, ERROR)


def run_label_job(
    postings: DataFrame,
    fn: ModelFunction,
    path: str,
    id_col: str,
    categories: Sequence[str] | Mapping[str, str] = tuple(MODEL_CATEGORIES),
    mode: str = "multilabel",
    n_slices: int = 1,
    **options,
) -> DataFrame:
    """Label every posting not yet in ``path`` and return the whole label table.

    Postings whose call failed are not in it; the next run asks for them again.
    """
    labellers = {"multilabel": label_multilabel, "per_category": label_per_category}
    if mode not in labellers:
        raise ValueError(f"mode must be one of {sorted(labellers)}, got {mode!r}")

    def label(pending: DataFrame) -> DataFrame:
        return labellers[mode](pending, fn, id_col, categories, **options)

    return run_resumable(postings, label, path, id_col, n_slices)
