"""Posting, label, answer and vector tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import materialize

ID = "job_posting_id"

# Title vocabulary (fixed test values, index 10 is a missing title).
TITLES = [
    "Business Analyst - Journeyman",
    "FP&A Analyst",
    "Financial Analyst II",
    "Junior Data Analyst",
    "Senior Data Analyst I",
    "Analyst I",
    "International Sales Analyst I",
    "Carpentry Helper",
    "Early Career Marketing Analyst",
    "Leadership Trainee",
    None,
    "Product Analytics Manager",
    "Data Science Intern",
    "Staffing Coordinator 1",
    "Marketing Analytics Specialist",
    "Reporting Specialist 1",
    "Business Analysts",
    "TREASURY ANALYST",
    "Recent Graduate Program",
    "Café éi Analyst",
]

# Label columns of the given label table, used as categories.
LABEL_CATEGORIES = ["quality", "toxic"]
LABEL_DESCRIPTIONS = {"quality": "Well written.", "toxic": "Offensive.", "spam": "Never labelled."}

# Widths of the two "models" compared: the stored vectors and their first half.
MODEL_DIMS = {"unit_64d": 64, "unit_32d": 32}
SLOTS = {64: ("embedding1", "demo/Hash-64"), 32: ("embedding2", "demo/Hash-32")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles() -> F.Column:
    return F.array(*[F.lit(t) for t in TITLES])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as postings; some descriptions are null, some blank."""
    n = F.col("n_chars")
    description = (
        F.when(n % 13 == 0, None).when(n % 17 == 0, F.lit("\t\n ")).otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ID),
        F.get(titles(), (n % len(TITLES)).cast("int")).alias("title"),
        description.alias("description"),
        F.col("source").alias("location"),
    )


def marked_up_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as raw postings: HTML, markdown bullets, markdown numbers, plain."""
    kind = F.col("n_chars") % 4
    text, nl = F.col("text"), F.lit("\n")
    as_html = F.concat(
        F.lit("<p>R&amp;D "), F.replace(text, nl, F.lit("</p><p>")), F.lit("</p>")
    )
    as_bullets = F.concat(F.lit("## Role\n* "), F.replace(text, nl, F.lit("\n* ")))
    as_numbers = F.concat(
        F.lit("**Tasks**\n1. "),
        F.replace(text, nl, F.lit("\n2. ")),
        F.lit(" [apply](http://x) `code`"),
    )
    raw = (
        F.when(kind == 0, as_html)
        .when(kind == 1, as_bullets)
        .when(kind == 2, as_numbers)
        .otherwise(F.when(F.col("n_chars") % 3 == 0, F.lit("<p> </p>\n")).otherwise(text))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ID),
        F.get(titles(), (F.col("n_chars") % len(TITLES)).cast("int")).alias("title"),
        raw.alias("description"),
        F.col("source").alias("location"),
    )


def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias(ID), *LABEL_CATEGORIES)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per labelled document, in seven shapes from clean to broken."""
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    as_bool = F.when(F.col("quality") == 1, "true").otherwise("false")
    shapes = [
        F.concat(F.lit('{"quality":'), q, F.lit(',"toxic":'), t, F.lit("}")),
        F.concat(F.lit('```json\n{"quality": '), as_bool, F.lit("}\n```")),
        F.concat(F.lit('Sure: {"quality":"'), q, F.lit('","toxic":[]} ok')),
        F.lit("no json"),
        F.lit("{quality:1} {\"quality\":1}"),
        F.concat(F.lit('{"x":{"toxic":'), t, F.lit('},"quality":1}')),
        F.lit('{"quality":0.0,"toxic":null}'),
    ]
    shape = F.get(F.array(*shapes), (F.col("doc_id") % len(shapes)).cast("int"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias(ID), shape.alias("raw"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_posting_id, category, embedding) of all vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(ID),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("category"),
        "embedding",
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per category: its vector with the lowest id. Stored, so that joins
    with it are planned on its true size."""
    lowest = (
        vectors(spark, sf_dir)
        .groupBy("category")
        .agg(F.min(ID).alias("query_id"), F.min_by("embedding", ID).alias("embedding"))
    )
    return materialize(lowest, "query-vectors")


def corpus_vectors(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    """All vectors but the queries."""
    used = queries.select(F.col("query_id").alias(ID))
    return vectors(spark, sf_dir).join(used, ID, "left_anti")
