"""Read postings, label matrices and vectors."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from sievemark.constants import POSTING_COLUMNS

log = logging.getLogger(__name__)

POSTING_SCHEMA = StructType([StructField(c, StringType()) for c in POSTING_COLUMNS])
FULL_QUERY = "SELECT * FROM job_postings"

# Quoted fields may span lines and hold doubled quotes.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def jdbc_options(
    url: str,
    query: str = FULL_QUERY,
    *,
    partition_column: str | None = None,
    lower_bound: int | str | None = None,
    upper_bound: int | str | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Reader options for the result of any query.

    With a partition column the query is read in parallel ranges; it then goes in as
    a derived table, because Spark takes no bounds together with ``query``.
    """
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    if partition_column is None:
        return options | {"query": query}
    if lower_bound is None or upper_bound is None or num_partitions is None:
        raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
    return options | {
        "dbtable": f"({query}) source_rows",
        "partitionColumn": partition_column,
        "lowerBound": str(lower_bound),
        "upperBound": str(upper_bound),
        "numPartitions": str(num_partitions),
    }


def read_query(spark: SparkSession, url: str, query: str = FULL_QUERY, **options) -> DataFrame:
    """Result of a database query; column names come from the result."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def read_with_fallback(
    spark: SparkSession,
    primary: Callable[[], DataFrame],
    cached: Callable[[], DataFrame] | None = None,
    schema: StructType = POSTING_SCHEMA,
) -> DataFrame:
    """The primary source; if it fails or is empty the cached one; else no rows."""
    for name, reader in (("primary", primary), ("cached", cached)):
        if reader is None:
            continue
        try:
            df = reader()
            if not df.isEmpty():
                return df
        except Exception as exc:  # any source error means "try the next one"
            log.warning("%s source failed: %s", name, exc)
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: StructType = POSTING_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_subsets(spark: SparkSession, path: str) -> DataFrame:
    """All category subsets as one table with the ``category`` partition column."""
    return spark.read.parquet(path)


def read_csv_subsets(
    spark: SparkSession, path: str, schema: StructType = POSTING_SCHEMA
) -> DataFrame:
    """Subsets written as CSV below ``category=…`` folders."""
    typed = StructType([*schema.fields, StructField("category", StringType())])
    return read_csv(spark, path, typed)
